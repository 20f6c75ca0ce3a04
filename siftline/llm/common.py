"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.session import configure, shared_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_FILE = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """`df` as a table in the shared folder: it is computed once, and a lost
    executor costs a later reader nothing but its own task. `rows`: a bound on its
    narrow rows, where one is known; it keeps small tables from many tiny files."""
    path = shared_folder(df.sparkSession, name)
    (df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(hashed: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(hashed, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def arrow_map(df: DataFrame, fn, schema: str | StructType, rows: int = 512) -> DataFrame:
    """`mapInArrow` with small batches: documents may be very long, and a batch
    is held in a Python worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)


class Memo(dict):
    """Results of `make` by argument, at most `limit` of them: it starts anew
    when full, so a worker's memory stays bounded and every result is exact."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
