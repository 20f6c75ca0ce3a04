"""Sorting, paging and top-k over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.browsers import newest_per_group
from siftline.operators.filters import attr
from siftline.session import shared_folder

SORT_KEYS = ["datetime", "event_type", "message", "id", "name", "state"]


def sort_key(df: DataFrame, name: str) -> Column:
    if name == "name":
        return F.coalesce(attr(df, "service_name"), attr(df, "ServiceName"), attr(df, "param1"), F.lit(""))
    if name == "state":
        return F.coalesce(attr(df, "param2"), F.lit(""))
    return F.col(name)


def ordering(df: DataFrame, by: str = "datetime", direction: str = "desc") -> list[Column]:
    """Sort columns: NULLs last ascending, first descending; `id` breaks ties.

    An unknown key falls back to the newest-first default.
    """
    if by not in SORT_KEYS:
        by, direction = "datetime", "desc"
    key = sort_key(df, by)
    main = key.desc_nulls_first() if direction.lower() == "desc" else key.asc_nulls_last()
    return [main, F.col("id").asc_nulls_last()]


def sort_events(df: DataFrame, by: str = "datetime", direction: str = "desc") -> DataFrame:
    return df.orderBy(*ordering(df, by, direction))


def numbered(df: DataFrame, by: str = "datetime", direction: str = "desc") -> DataFrame:
    """(id, pos) of every event: its place in the whole order, from 1.

    The sort keys are dealt into ranges, numbered inside each, and start at the
    count of the ranges before, so no task holds the whole order.
    """
    tie = F.col("id").asc_nulls_last()
    path = shared_folder(df.sparkSession, "order")
    key = sort_key(df, by if by in SORT_KEYS else "datetime")
    main = F.col("_key").desc_nulls_first() if direction.lower() == "desc" or by not in SORT_KEYS else F.col("_key").asc_nulls_last()
    keys = df.select("id", key.alias("_key"))
    keys.repartitionByRange(main, tie).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    # One row a range, so this window is as small as the number of ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(main, tie))
    return kept.withColumn("_place", place).join(starts, "_range").select("id", (F.col("_start") + F.col("_place")).alias("pos"))


def page(df: DataFrame, offset: int = 0, limit: int = 100, by: str = "datetime", direction: str = "desc") -> DataFrame:
    """One page; with a limit Spark keeps only the top rows of each task."""
    return sort_events(df, by, direction).offset(offset).limit(limit)


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """`total` and `has_more` of a filtered set (one distributed count)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def next_page(df: DataFrame, after_time, after_id, limit: int = 100) -> DataFrame:
    """Page after a known (datetime, id) in the default order. The bound is a
    filter, so deep pages cost no more than the first one."""
    at = F.lit(after_time).cast("timestamp")
    later = (F.col("datetime") < at) | ((F.col("datetime") == at) & (F.col("id") > after_id))
    return df.where(later).orderBy(*ordering(df)).limit(limit)


def top_counts(df: DataFrame, col: Column, name: str, k: int = 5) -> DataFrame:
    """The k most frequent values; equal counts are ordered by value."""
    return (
        df.groupBy(col.alias(name)).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(name).asc_nulls_last()).limit(k)
    )


def counts_with_total(df: DataFrame, name: str) -> DataFrame:
    """Counts per value and, as value NULL, the total."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias(name), "n")
    return counts.unionByName(total)


def first_children(pairs: DataFrame, n: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Distinct (dir, child) pairs -> first n children per directory (and `keys`) by
    name, and how many more there are."""
    group = [*(keys or []), "dir"]
    pairs = pairs.select(*group, "child").distinct()
    counts = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    head = newest_per_group(pairs, group, [F.col("child").asc()], n)
    listed = head.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("child")), "|").alias("children"))
    return listed.join(counts, group).select(
        *group, "children", F.greatest(F.col("total") - n, F.lit(0)).alias("more")
    )
