"""Stream jobs: arriving captures, dedupe, counters, tagging, failure windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from siftline.functions.values import any_of
from siftline.operators.build import emit, key_digest
from siftline.operators.detect import detect, fold
from siftline.operators.filters import NOTABLE
from siftline.operators.summaries import NOISY_EVENTS, REMOTE_TOOLS, remote_tool
from siftline.schema import DEDUPE_KEY, EVENT_COLUMNS, EVENT_SCHEMA
from siftline.sources.rules import RuleSet
from siftline.sources.timeline import add_events, event_columns, parse_lines, promote, save_events, with_id

LANDING = r"/([^/]+)/([^/]+)/[^/]*$"


def arriving_lines(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """Lines of new files under `<landing>/<site>/<capture>/`. A stream has no
    row counter, so `seq` is the start of the line's file block."""
    raw = (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True).load(landing)
    )
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, LANDING, 1).alias("site_id"), F.regexp_extract(path, LANDING, 2).alias("upload_id"),
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("seq"),
    )


def arriving_events(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    return parse_lines(arriving_lines(spark, landing, max_files))[0]


def dedupe_stream(events: DataFrame, life: str = "30 days", arrived: Column | None = None) -> DataFrame:
    """Drop repeats of the dedupe key that arrive while their capture is open, that is
    within `life` of the key's first arrival; then its state is freed.

    The state holds 128 bits of a key, no text. The clock is that of arrival
    (`arrived`, by default now): captures hold years of events in any order, so a
    watermark on the event's own time would drop history. `stream_captures` knows no
    such end, for it asks the table.
    """
    keys = [k for k in DEDUPE_KEY if k in events.columns]
    arriving = events.withColumns({
        "_arrived": F.current_timestamp() if arrived is None else arrived, "_k1": key_digest(keys, 1), "_k2": key_digest(keys, 2)})
    return arriving.withWatermark("_arrived", life).dropDuplicatesWithinWatermark(["_k1", "_k2"]).drop("_arrived", "_k1", "_k2")


def stream_timeline(
    spark: SparkSession, landing: str, table: str, checkpoint: str, rules: RuleSet | None = None, once: bool = True
) -> StreamingQuery:
    """Append arriving captures to the event table. The file sink's own log makes
    each file's rows appear exactly once, also after a restart."""
    events = dedupe_stream(arriving_events(spark, landing))
    if rules is not None:
        events = tag_stream(events, rules).select(*EVENT_COLUMNS)
    out = promote(with_id(events))
    writer = (
        out.writeStream.format("parquet").outputMode("append").partitionBy("site_id", "upload_id")
        .option("path", table).option("checkpointLocation", checkpoint)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()


def stream_captures(spark: SparkSession, landing: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Like `stream_timeline`, but whole captures stay deduplicated, however long they
    are open: of a micro-batch only those events are added, as new files, whose id the
    table does not hold. Only ids are read, and only of the captures in the batch. So a
    capture may arrive in any number of files and batches, what is written grows with
    the batch alone, and files that land again, or a batch that is repeated after a
    failure, add nothing. `close_captures` joins a capture's files when it is complete."""
    def load(batch: DataFrame, number: int) -> None:
        staged = f"{checkpoint}/staged/{number}"
        new = event_columns(emit(batch.withColumn("seq", F.monotonically_increasing_id())))
        with_id(new).write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(StructType([*EVENT_SCHEMA.fields, StructField("id", StringType())])).parquet(staged)
        captures = rows.select("site_id", "upload_id").distinct().collect()
        held = stored(spark, table)
        if held is not None and captures:
            rows = rows.join(of_captures(held, captures).select("id"), "id", "left_anti")
        add_events(rows, table)

    writer = arriving_events(spark, landing).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def of_captures(events: DataFrame, captures: list) -> DataFrame:
    """Rows of the named captures ((site_id, upload_id) pairs): literal conditions, so
    that only their partitions are listed and read."""
    return events.where(any_of([(F.col("site_id") == s) & (F.col("upload_id") == u) for s, u in captures]))


def close_captures(spark: SparkSession, table: str, captures: list, staging: str) -> None:
    """Rewrite the named captures' files, one set each, sorted for pruning. The rows are
    staged first, so a failure leaves the old files or the new ones, and a repeat ends
    in the same table."""
    rows = event_columns(of_captures(stored(spark, table), captures))
    rows.write.mode("overwrite").parquet(staging)
    save_events(spark.read.schema(EVENT_SCHEMA).parquet(staging), table)


def stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The event table, None where there is none yet."""
    try:
        return spark.read.parquet(table)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def type_counters(events: DataFrame) -> DataFrame:
    """Running events per type, with notable and suspicious ones."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ct_significance") == NOTABLE).alias("notable"),
        F.count_if("is_suspicious").alias("suspicious"),
    )


def tool_counters(events: DataFrame) -> DataFrame:
    """Running remote-access events per tool."""
    names = F.array(*[F.lit(n) for n, _, _ in REMOTE_TOOLS])
    hits = events.where(~F.col("event_type").isin(NOISY_EVENTS)).withColumn("tool", remote_tool(F.col("message")))
    return hits.where(F.col("tool").isNotNull()).groupBy(F.get(names, F.col("tool")).alias("tool_name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen")
    )


def tag_stream(events: DataFrame, rules: RuleSet) -> DataFrame:
    """Rule tagging: row-local, so it runs on a stream as it does on a table."""
    return fold(detect(events, rules), rules)


def failure_windows(events: DataFrame, width: str = "10 minutes", delay: str | None = None) -> DataFrame:
    """Logon failures per host and tumbling window. Every row counts, however old,
    for complete or update output. Append output needs a `delay`; it closes windows
    for good, and rows that come later than that are not in them."""
    failed = (F.col("event_type") == "logon_failed") | (
        (F.col("event_type") == "windows_logon") & (F.col("attrs")["event_identifier"] == "4625")
    )
    found = events.where(failed)
    return (
        (found if delay is None else found.withWatermark("datetime", delay))
        .groupBy(F.window("datetime", width).alias("w"), "host_name").agg(F.count(F.lit(1)).alias("failures"))
        .select("host_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "failures")
    )
