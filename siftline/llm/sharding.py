"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a number from the record key; the shard with the highest
`-weight / ln(u)` takes the record. A key's draws for the old shards do not
change when a shard is added, so the new shard only takes records for itself
(about its share of them), and a removed one only gives its own away.

A null key is a key like any other. Rows that share a key share a shard. Extra
columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import unit_interval, written


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into `weights`) of a key; a weight of 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    draws = [
        F.struct((F.lit(float(w)) / -F.log(unit_interval(F.xxhash64(key, F.lit(s))))).alias("draw"),
                 F.lit(-s).alias("minus"))
        for s, w in enumerate(weights) if w > 0
    ]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["minus"]).cast("int")


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8,
    grown_weights: Sequence[float] | None = None,
) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes + 1; null text: 1),
    text_crc32 (null text: of nothing, 0), shard, grown_shard (under
    `grown_weights`, default one more shard of weight 1)."""
    grown = tuple(grown_weights) if grown_weights is not None else (*weights, 1.0)
    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), (F.octet_length(filled) + F.lit(1)).cast("long").alias("size"),
        F.crc32(filled.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"),
    )


def with_slots(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `slot`: the gapless place of a row in its shard, in key order (rows
    with equal keys by checksum; rows equal in both are interchangeable).

    No shard is ordered in one task. Rows are dealt into ranges of the key, are
    numbered within (range, shard), and start at the count of their shard in the
    ranges before. The last range column splits a key that holds very many rows.
    """
    ranged = (
        assigned.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(F.col(key).asc_nulls_first(), "text_crc32", "_row")
        .withColumn("_range", F.spark_partition_id())
    )
    kept = written(ranged, "shard-ranges")
    inside = Window.partitionBy("_range", "shard").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "_row")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    numbered = kept.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["_range", "shard"]).select(
        *assigned.columns, (F.col("_start") + F.col("_place")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8) -> None:
    """Writes the rows, all columns, below `path/shard=<n>`."""
    docs.withColumn("shard", shard_of(F.col(key), weights)).write.partitionBy("shard").parquet(path)
