"""Timeline files (JSON lines) and the stored event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import blank_to_null, strip_control_escapes
from siftline.functions.times import INGEST_FORMATS
from siftline.functions.values import drop_empty, loose_boolean, once, parse_map
from siftline.operators.build import key_digest
from siftline.schema import DEDUPE_KEY, EVENT_COLUMNS, EVENT_SCHEMA, PROMOTED

BASE_KEYS = [
    "datetime", "timestamp_desc", "message", "event_type", "data_type", "source_short", "source_long", "host_name",
]


def ingest_time(col: Column) -> Column:
    """Timestamp of a timeline line; NULL when no accepted format fits."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in INGEST_FORMATS])


def _json_object(line: Column) -> Column:
    """Attribute map of a line that holds one valid JSON object, else NULL."""
    valid = F.startswith(F.ltrim(line), F.lit("{")) & F.try_parse_json(line).isNotNull()
    return F.when(valid, parse_map(line))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (`line`, `upload_id`, `site_id`, `seq`) -> (events, rejects).

    A reject is a line that is no JSON object, or whose datetime cannot be read;
    it is kept with its reason instead of being given the wall clock.
    """
    parsed = (
        lines.where(F.trim("line") != "")
        .withColumn("line", strip_control_escapes(F.col("line")))
        .withColumn("attrs", once(_json_object(F.col("line"))))
        .withColumn("_at", once(ingest_time(F.col("attrs")["datetime"])))
    )

    def text(name: str) -> Column:
        return blank_to_null(F.col("attrs")[name])

    good = parsed.where(F.col("_at").isNotNull()).select(
        "upload_id", "site_id", text("host_name").alias("host_name"), "seq", F.col("_at").alias("datetime"),
        text("timestamp_desc").alias("timestamp_desc"), text("message").alias("message"),
        F.coalesce(text("event_type"), F.lit("unknown")).alias("event_type"), text("data_type").alias("data_type"),
        text("source_short").alias("source_short"), text("source_long").alias("source_long"),
        text("ct_significance").alias("ct_significance"),
        loose_boolean(F.col("attrs")["is_suspicious"]).alias("is_suspicious"), "attrs", F.lit(None).cast("string").alias("content"),
    )
    reason = F.when(F.col("attrs").isNull(), F.lit("not a JSON object")).otherwise(F.lit("unreadable datetime"))
    bad = parsed.where(F.col("_at").isNull()).select("upload_id", "site_id", "seq", "line", reason.alias("reason"))
    return good, bad


def timeline_lines(spark: SparkSession, path: str, site_id: str, upload_id: str) -> DataFrame:
    """Text lines of a timeline with a sequence that follows file order."""
    # (file block start, position in block) orders lines of one file; the id of
    # Spark's own counter is increasing inside a partition.
    return spark.read.text(path).select(
        F.lit(site_id).alias("site_id"), F.lit(upload_id).alias("upload_id"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_timeline(spark: SparkSession, path: str, site_id: str, upload_id: str) -> tuple[DataFrame, DataFrame]:
    """A timeline file -> (events, rejects)."""
    return parse_lines(timeline_lines(spark, path, site_id, upload_id))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.length("value") > 0).count()


def event_json(df: DataFrame, name: str = "value") -> DataFrame:
    """Add one JSON object per event: base fields, then attributes. The base
    fields stay authoritative: an attribute of the same name but another value
    is written as `data.<name>`. Empties are left out."""
    base = {
        "datetime": F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        **{k: F.col(k) for k in BASE_KEYS if k != "datetime"},
        "ct_significance": F.col("ct_significance"),
        "is_suspicious": F.when(F.col("is_suspicious"), F.lit("true")),
    }
    flat = [c for k, v in base.items() for c in (F.lit(k), v)]
    filled = F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))
    df = df.withColumn("_base", once(filled)).withColumn("_rest", drop_empty(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))))
    kept = F.map_filter("_rest", lambda k, v: ~F.coalesce(F.col("_base")[k] == v, F.lit(False)))
    renamed = F.transform_keys(
        kept, lambda k, _: F.when(F.map_contains_key(F.col("_base"), k), F.concat(F.lit("data."), k)).otherwise(k)
    )
    return df.withColumn(name, F.to_json(F.map_concat("_base", renamed))).drop("_base", "_rest")


def write_timeline(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    event_json(df).select("value").write.mode(mode).text(path)


def with_id(df: DataFrame) -> DataFrame:
    """Deterministic event id: 128 bits of the dedupe key, in which the capture is."""
    keys = [k for k in DEDUPE_KEY if k in df.columns]
    return df.withColumn("id", F.concat(*[F.lpad(F.lower(F.hex(key_digest(keys, salt))), 16, "0") for salt in (1, 2)]))


def event_columns(df: DataFrame) -> DataFrame:
    """The event columns; those that `df` lacks are NULL."""
    kinds = {f.name: f.dataType for f in EVENT_SCHEMA.fields}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in EVENT_COLUMNS])


def promote(df: DataFrame) -> DataFrame:
    """Hot attributes as columns, so that their filters use file statistics."""
    return df.select("*", *[F.col("attrs")[n].alias(n) for n in PROMOTED if n not in df.columns])


def save_events(df: DataFrame, path: str) -> None:
    """Write events into the table, one partition per site and capture. A
    capture that is loaded again replaces itself (dynamic overwrite).

    The rebalance hint lets Spark split a capture that holds much of the data
    over many tasks and join small ones; inside a file rows are sorted by type
    and time, so that row-group statistics prune.
    """
    out = promote(with_id(event_columns(df)))
    (
        out.hint("rebalance", "site_id", "upload_id")
        .sortWithinPartitions("site_id", "upload_id", "event_type", "datetime")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("site_id", "upload_id").parquet(path)
    )


def add_events(df: DataFrame, path: str) -> None:
    """Append events to their captures' partitions as further files."""
    out = promote(with_id(event_columns(df)))
    (
        out.hint("rebalance", "site_id", "upload_id").sortWithinPartitions("site_id", "upload_id", "event_type", "datetime")
        .write.mode("append").partitionBy("site_id", "upload_id").parquet(path)
    )


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    """Per-capture results (such as remote-access tools), replaced per capture."""
    (
        df.repartition("upload_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("upload_id").parquet(path)
    )
