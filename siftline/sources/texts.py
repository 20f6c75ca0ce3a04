"""Text files of captures: lenient decoding, ordered lines of files of any size, and
tables with a heading of their own.

A file is read in splits. A line's number follows from the file, the start of its split
and its place there: places are counted per split, and only one row per split is ordered
within a file. Bytes that are no text never end a job: they become U+FFFD, and
`text_problems` tells which files have some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators.lines import CHUNK, carry_forward

CAPTURE = r"([^/]+)/(?:live|artifacts|sections|manifest\.json)"
MARKS = {"UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}


def upload_of(path: Column, pattern: str = CAPTURE) -> Column:
    return F.regexp_extract(path, pattern, 1)


def relative(path: Column, root: str) -> Column:
    """The path below `root`, or the file's name."""
    return F.regexp_replace(path, "^.*/" + root + "/" if root else "^.*/", "")


def decoded(content: Column) -> Column:
    """Bytes of a whole file as text, by the mark at its start (UTF-16, or UTF-8 with
    and without one). Bytes that do not fit are replaced."""
    size = F.octet_length(content)
    plain = F.make_valid_utf8(content.cast("string"))
    chain = F.when(size < 2, plain)
    for name, mark in MARKS.items():
        # Half a character at the end can't be read.
        even = F.substring(content, F.lit(3), (F.floor(size / 2) * 2 - 2).cast("int"))
        chain = chain.when(F.substring(content, 1, 2) == F.lit(bytearray(mark)), F.decode(even, name))
    return chain.when(plain.startswith("﻿"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain)


def encoding(content: Column) -> Column:
    """How `decoded` reads the bytes: utf-8, utf-16, or utf-8 with replaced bytes."""
    marked = F.substring(content, 1, 2).isin(*[F.lit(bytearray(m)) for m in MARKS.values()])
    return F.when(marked, F.lit("utf-16")).when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")).otherwise(F.lit("replaced"))


def read_texts(spark: SparkSession, paths: str | list[str], root: str = "") -> DataFrame:
    """Whole text files, for formats that can't be cut (`rel` is the path below
    `root`), with size, mtime and encoding."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(
        upload_of(F.col("path")).alias("upload_id"), F.col("path").alias("file"), relative(F.col("path"), root).alias("rel"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), encoding(F.col("content")).alias("encoding"),
        decoded(F.col("content")).alias("text"), F.monotonically_increasing_id().alias("seq"),
    )


def text_problems(texts: DataFrame) -> DataFrame:
    """Files of which bytes were replaced, with the reason."""
    return texts.where("encoding = 'replaced'").select("upload_id", "file", F.lit("bytes that are no UTF-8 were replaced").alias("reason"))


def read_lines(spark: SparkSession, paths: str | list[str], root: str = "", encoding: str | None = None, reader: DataFrameReader | None = None) -> DataFrame:
    """Lines of text files, numbered from 1: upload_id, file, rel, size, mtime, seq,
    line_no, line. `encoding` (UTF-16LE, UTF-16BE) is needed where lines are not UTF-8; `reader`
    brings options of its own."""
    reader = reader or spark.read
    if encoding is not None:
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    meta = lambda name: F.col(f"_metadata.{name}")
    line = F.make_valid_utf8("value") if encoding is None else F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "\r$", "")
    raw = reader.text(paths).select(
        meta("file_path").alias("file"), meta("file_block_start").alias("_start"), meta("file_size").alias("size"),
        meta("file_modification_time").alias("mtime"), F.monotonically_increasing_id().alias("seq"), line.alias("line"))
    counted = raw.groupBy("file", "_start").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("seq") - F.col("_first") + 1).alias("line_no")
    marked = F.when(F.col("line").startswith("﻿"), F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line"))
    return raw.join(splits, ["file", "_start"]).select(
        upload_of(F.col("file")).alias("upload_id"), "file", relative(F.col("file"), root).alias("rel"), "size", "mtime", "seq", number, marked.alias("line"))


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Add `out`: the sum of `value` over all earlier rows of the group; inside
    chunks of `chunk` rows and then over one row per chunk."""
    df = df.withColumn("_v", value).withColumn("_chunk", F.call_function("div", F.col(order).cast("long"), F.lit(chunk).cast("long")))
    earlier = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_chunk").agg(F.sum("_v").alias("_s")).select(*group, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    return df.join(sums, [*group, "_chunk"]).withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(earlier), F.lit(0))).drop("_v", "_chunk", "_base")


def csv_rows(lines: DataFrame) -> DataFrame:
    """CSV files, each with its own heading -> `rec` (heading -> trimmed value), with the
    keys of the line frame; `line_no` is that of the row's first line.

    A value may run over several lines: a row starts where an even number of quotes
    stands before the line. Only rows of several lines are put together by a shuffle.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    told = running_sum(lines.withColumn("_odd", quotes % 2), ["file"], "line_no", F.col("_odd"), "_open")
    told = told.withColumn("_starts", F.col("_open") % 2 == 0)
    whole = told.where(F.col("_starts") & (F.col("_odd") == 0))
    parts = carry_forward(told.where(~F.col("_starts") | (F.col("_odd") == 1)), ["file"], "line_no", F.when(F.col("_starts"), F.col("line_no")), "_row")
    keys = [c for c in lines.columns if c not in ("line", "line_no", "file")]
    put = parts.groupBy("file", F.col("_row").alias("line_no")).agg(
        *[F.min_by(c, "line_no").alias(c) for c in keys],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("line"))
    rows = whole.select(*lines.columns).unionByName(put.select(*lines.columns))
    # A heading is a file's first row; how many columns the widest has is all the driver learns.
    heads = rows.where("line_no = 1").select("file", F.col("line").alias("_head"))
    most = heads.agg(F.max(F.length("_head") - F.length(F.replace("_head", F.lit(","), F.lit(""))))).first()[0]
    kind = ", ".join(f"c{i} string" for i in range((most or 0) + 1))

    def cells(col: Column) -> Column:
        row = F.from_csv(col, kind, {"quote": '"', "escape": '"', "multiLine": "true"})
        return F.array(*[row[f"c{i}"] for i in range((most or 0) + 1)])

    names = F.filter(F.transform(cells(F.col("_head")), lambda n: F.trim(n)), lambda n: n.isNotNull())
    pairs = F.arrays_zip(F.col("_names"), F.transform(cells(F.col("line")), lambda v: F.trim(F.coalesce(v, F.lit("")))).alias("_values"))
    kept = F.filter(pairs, lambda p: p["_names"].isNotNull())
    return rows.where((F.col("line_no") > 1) & (F.trim("line") != "")).join(heads, "file").withColumn("_names", names).select(
        *[c for c in lines.columns if c != "line"],
        F.map_from_entries(F.transform(kept, lambda p: F.struct(p["_names"], p["_values"]))).alias("rec")).drop("_head", "_names")


def dash_rows(lines: DataFrame) -> DataFrame:
    """Fixed-width tables whose column edges are given by a line of dashes: one row
    per table row with `rec` = column name -> cell and `row_no` from 0.

    A column runs from the start of its dashes to the start of the next ones; the last
    one is open. A file's table begins at its first line of dashes below a heading and
    ends at the next one. Only lines of dashes are compared with their neighbours.
    """
    dashes = lines.where(F.col("line").rlike("^[ -]*---[ -]*$")).select("file", F.col("line_no").alias("_at"), F.col("line").alias("_dash"))
    heads = lines.select("file", (F.col("line_no") + 1).alias("_at"), F.col("line").alias("_head")).where(F.trim("_head") != "")
    first = dashes.join(heads, ["file", "_at"]).groupBy("file").agg(F.min(F.struct("_at", "_dash", "_head")).alias("t")).select("file", "t.*")
    ends = dashes.select("file", F.col("_at").alias("_end")).join(first.select("file", "_at"), "file").where("_end > _at").groupBy("file").agg(F.min("_end").alias("_end"))
    tables = first.join(ends, "file", "left")
    one = lambda p: F.substring("_dash", p, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), F.length("_dash")), lambda p: (one(p) == "-") & ((p == 1) | (one(F.greatest(p - 1, F.lit(1))) != "-")))

    def cells(row: str) -> Column:
        return F.transform("_starts", lambda s, i: F.trim(F.substring(row, s, F.coalesce(F.get("_starts", i + 1) - s, F.length(row)))))

    rows = lines.join(tables, "file").where((F.col("line_no") > F.col("_at")) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))) & (F.trim("line") != ""))
    return rows.withColumn("_starts", starts).select(
        *[c for c in lines.columns if c not in ("line", "line_no")], (F.col("line_no") - F.col("_at") - 1).cast("int").alias("row_no"),
        F.map_from_arrays(cells("_head"), cells("line")).alias("rec"))
