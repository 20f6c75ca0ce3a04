"""Ordered text lines: carrying values forward, blocks, fixed-width tables.

A line frame has the capture keys, `file` and `line_no`, and `line`. A single
file may hold a large share of all lines, so ordered folds never sort a whole
file in one task: lines are cut into chunks of `chunk` line numbers, chunks are
folded on their own, and only one summary row per chunk is ordered per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 50_000


def carry_forward(
    df: DataFrame, group: list[str], order: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Add `out`: the last non-NULL `value` at or before each row, per group.

    `order` is an integer column. Two levels: inside a chunk by a running
    window, between chunks by a window over one row per chunk.
    """
    df = df.withColumn("_v", value).withColumn("_chunk", F.call_function("div", F.col(order).cast("long"), F.lit(chunk).cast("long")))
    inside = (
        Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        df.where(F.col("_v").isNotNull())
        .groupBy(*group, "_chunk")
        .agg(F.max_by("_v", order).alias("_end"))
    )
    chunks = df.select(*group, "_chunk").distinct().join(ends, [*group, "_chunk"], "left")
    carried = chunks.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        df.join(carried, [*group, "_chunk"])
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_v", "_chunk", "_carry")
    )


def blocks(lines: DataFrame, group: list[str], is_header: Column, chunk: int = CHUNK) -> DataFrame:
    """Add `block`: the line number of the header the line belongs to (NULL
    before the first header)."""
    return carry_forward(lines, group, "line_no", F.when(is_header, F.col("line_no")), "block", chunk)


def block_records(lines: DataFrame, group: list[str], fields: list[str], sep: str = ":") -> DataFrame:
    """Blocks of `Key: value` lines -> one row per block with `rec`, holding the
    listed fields; a repeated key keeps its last value."""
    key = F.trim(F.substring_index(F.col("line"), sep, 1))
    value = F.trim(F.expr(f"substring(line, instr(line, '{sep}') + 1)"))
    pairs = lines.where(F.col("line").contains(sep) & F.col("block").isNotNull()).select(
        *group, "block", "line_no", key.alias("k"), value.alias("v")
    )
    aggs = [
        F.max_by("v", F.when(F.col("k") == f, F.col("line_no"))).alias(f"f{i}") for i, f in enumerate(fields)
    ]
    folded = pairs.where(F.col("k").isin(fields)).groupBy(*group, "block").agg(*aggs)
    flat = [c for i, f in enumerate(fields) for c in (F.lit(f), F.col(f"f{i}"))]
    return folded.select(
        *group, "block", F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull()).alias("rec")
    )


def split_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Whole file texts -> one row per line with its number (from 1)."""
    return (
        texts.select("*", F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))
        .withColumn("line_no", F.col("pos") + 1)
        .drop("pos", text)
    )


def dash_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """Fixed-width tables whose column edges are given by a line of dashes.

    One row per table row with `rec` = column name -> cell. A column runs from
    the start of its dashes to the start of the next ones; the last one is open.
    Reading stops at the next dash line. All work is on the file's own row, as
    such listings are small; nothing is shuffled.
    """
    is_dash = "^[ -]*---[ -]*$"
    rows = F.split(F.col(text), "\r?\n")
    df = texts.withColumn("_rows", rows).withColumn(
        "_dash",
        F.array_position(
            F.transform(F.col("_rows"), lambda r, i: r.rlike(is_dash) & (i > 0) & (F.trim(F.get(F.col("_rows"), i - 1)) != "")),
            F.lit(True),
        ).cast("int"),
    ).where(F.col("_dash") > 1)
    dash = F.element_at("_rows", F.col("_dash"))
    marks = F.sequence(F.lit(1), F.length(dash))
    starts = F.filter(
        marks,
        lambda p: (F.substring(dash, p, F.lit(1)) == "-")
        & ((p == 1) | (F.substring(dash, F.greatest(p - 1, F.lit(1)), F.lit(1)) != "-")),
    )
    df = (
        df.withColumn("_starts", starts)
        .withColumn("_head", F.element_at("_rows", F.col("_dash") - 1))
        .withColumn("_body", F.slice("_rows", F.col("_dash") + 1, F.size("_rows")))
    )
    stop = F.array_position(F.transform("_body", lambda r: r.rlike(is_dash)), F.lit(True)).cast("int")
    df = df.withColumn("_body", F.when(stop > 0, F.slice("_body", F.lit(1), stop - 1)).otherwise(F.col("_body")))

    def cells(row: Column) -> Column:
        return F.transform(
            F.col("_starts"),
            lambda s, i: F.trim(
                F.substring(row, s, F.coalesce(F.get(F.col("_starts"), i + 1) - s, F.length(row)))
            ),
        )

    return (
        df.select(
            *texts.drop(text).columns, "_starts", "_head", F.posexplode("_body").alias("row_no", "_row")
        )
        .where(F.trim("_row") != "")
        .withColumn("rec", F.map_from_arrays(cells(F.col("_head")), cells(F.col("_row"))))
        .drop("_starts", "_head", "_row")
    )


def whitespace_fields(limit: int = -1) -> Column:
    """Fields of the trimmed `line` split at runs of white space."""
    return F.split(F.trim(F.col("line")), r"\s+", limit)


def as_record(names: list[str], parts: Column) -> Column:
    """Positional parts -> record map; absent parts are left out."""
    flat = [c for i, n in enumerate(names) for c in (F.lit(n), F.get(parts, F.lit(i)))]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())
