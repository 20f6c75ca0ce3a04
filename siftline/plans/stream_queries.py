"""Stream jobs run to the end over a whole table (available-now trigger).

Each writes its result as a table in the shared folder and returns that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.times import iso_ms
from siftline.functions.values import attribute_map
from siftline.plans.detection_queries import rule_set
from siftline.plans.mapping import WITH_EVENTS, read
from siftline.plans.registry import query
from siftline.session import shared_folder
from siftline.streaming import jobs

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of event frames."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    user = F.col("user_id").cast("string")
    failed = F.col("event_type") == "error"
    return raw.select(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("upload_id"), F.lit("s0").alias("site_id"),
        F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host_name"), F.col("event_id").alias("seq"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("datetime"), F.lit("d").alias("timestamp_desc"),
        F.concat(F.lit("user "), user, F.when(F.col("user_id") % 3 == 0, F.lit(" anydesk")).otherwise(F.lit(""))).alias("message"),
        F.when(failed, F.lit("logon_failed")).otherwise(F.col("event_type")).alias("event_type"), F.lit("x").alias("data_type"),
        F.lit("s").alias("source_short"), F.lit("l").alias("source_long"),
        F.when(F.col("value") > 100, F.lit("LikelyNotable")).alias("ct_significance"), (F.col("value") > 200).alias("is_suspicious"),
        attribute_map({
            "event_identifier": F.when(F.col("event_type") == "purchase", F.lit("5156")), "channel": F.lit("Sysmon"),
            "process_name": F.when(F.col("user_id") % 7 == 0, F.lit("rclone.exe")),
        }).alias("attrs"),
    )


def _finish(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Run to the end. Append mode uses the file sink; complete mode replaces
    the result table with each micro-batch."""
    out, ckpt = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-ckpt")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    job = writer.start()
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


_BASE = f"""{WITH_EVENTS}, e AS (SELECT *, 'u' || (user_id % 4) AS upload_id, 'host' || (user_id % 5) AS host_name, date_trunc('hour', ts) AS h,
 'user ' || user_id || CASE WHEN user_id % 3 = 0 THEN ' anydesk' ELSE '' END AS message, CASE WHEN kind = 'error' THEN 'logon_failed' ELSE kind END AS event_type FROM ev)"""


@query("j01_stream_captures", f"""{_BASE}, t AS (SELECT *, h - INTERVAL 1 YEAR * (user_id % 3) AS w FROM e)
SELECT DISTINCT 's0' AS site_id, upload_id, strftime(w, '{ISO}') AS datetime, message, event_type FROM t""")
def stream_captures(spark, sf):
    """Captures that arrive in three batches and hold events years apart; the first
    file of all lands twice."""
    landing, table, ckpt = (shared_folder(spark, f"captures-{n}") for n in ("landing", "table", "ckpt"))
    user = F.col("user_id").cast("string")
    events = read(spark, sf, "events").select(
        F.lit("s0").alias("site"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("capture"), (F.col("event_id") % 3).alias("batch"),
        F.to_json(F.struct(
            iso_ms(F.date_trunc("hour", F.col("ts").cast("timestamp")) - F.make_ym_interval(F.col("user_id").cast("int") % 3, F.lit(0))).alias("datetime"),
            F.lit("d").alias("timestamp_desc"), F.when(F.col("event_type") == "error", F.lit("logon_failed")).otherwise(F.col("event_type")).alias("event_type"),
            F.concat(F.lit("user "), user, F.when(F.col("user_id") % 3 == 0, F.lit(" anydesk")).otherwise(F.lit(""))).alias("message"),
        )).alias("value"))
    for part in (events.where("batch = 0"), events.where("batch = 1"), events.where("batch <> 1")):
        part.select("site", "capture", "value").write.mode("append").partitionBy("site", "capture").text(landing)
        jobs.stream_captures(spark, landing, table, ckpt).awaitTermination()
    # Folder names are the captures' keys here.
    name = lambda c: F.substring_index(c, "=", -1).alias(c)
    return spark.read.parquet(table).select(name("site_id"), name("upload_id"), iso_ms(F.col("datetime")).alias("datetime"), "message", "event_type")


@query("j02_stream_dedupe", f"{_BASE} SELECT DISTINCT upload_id, strftime(h, '{ISO}') AS datetime, message, event_type FROM e")
def stream_dedupe(spark, sf):
    out = _finish(spark, jobs.dedupe_stream(_stream(spark, sf)), "append")
    return out.select("upload_id", iso_ms(F.col("datetime")).alias("datetime"), "message", "event_type")


@query("j03_stream_type_counters", f"{_BASE} SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS notable, count(*) FILTER (value > 200) AS suspicious FROM e GROUP BY 1")
def stream_type_counters(spark, sf):
    return _finish(spark, jobs.type_counters(_stream(spark, sf)), "complete")


@query("j03_stream_tool_counters", f"{_BASE} SELECT 'AnyDesk' AS tool_name, count(*) AS n, strftime(min(h), '{ISO}') AS first_seen, strftime(max(h), '{ISO}') AS last_seen FROM e WHERE user_id % 3 = 0")
def stream_tool_counters(spark, sf):
    out = _finish(spark, jobs.tool_counters(_stream(spark, sf)), "complete")
    return out.select("tool_name", "n", iso_ms(F.col("first_seen")).alias("first_seen"), iso_ms(F.col("last_seen")).alias("last_seen"))


@query("j04_stream_tagging", f"{_BASE} SELECT id, CASE WHEN user_id % 7 = 0 THEN 'NOTABLE' ELSE 'LIKELY_NOTABLE' END AS score FROM e WHERE kind = 'purchase' OR user_id % 7 = 0")
def stream_tagging(spark, sf):
    tagged = jobs.tag_stream(_stream(spark, sf), rule_set(spark)).where(F.size("detections") > 0)
    out = _finish(spark, tagged.select(F.col("seq").alias("id"), F.col("attrs")["cloudrules_score"].alias("score")), "append")
    return out


@query("j05_stream_failure_windows", f"{_BASE} SELECT host_name, strftime(time_bucket(INTERVAL 10 MINUTE, h), '{ISO}') AS start, count(*) AS failures FROM e WHERE event_type = 'logon_failed' GROUP BY 1, 2")
def stream_failure_windows(spark, sf):
    out = _finish(spark, jobs.failure_windows(_stream(spark, sf)), "complete")
    return out.select("host_name", iso_ms(F.col("start")).alias("start"), "failures")
