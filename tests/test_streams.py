"""Stream jobs over files that land while they run."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from siftline.plans import mapping
from siftline.plans.detection_queries import rule_set
from siftline.sources.timeline import save_events
from siftline.streaming import jobs


def land(root, site, upload, name, rows):
    folder = root / site / upload
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")


def line(minute, message, **more):
    return {"datetime": f"2024-01-01T00:{minute:02d}:00.000Z", "timestamp_desc": "d", "message": message, "event_type": "t"} | more


def test_new_files_are_appended_once(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    land(landing, "s1", "u1", "a.jsonl", [line(1, "a"), line(1, "a"), line(2, "b")])
    jobs.stream_timeline(spark, str(landing), table, ckpt).awaitTermination()
    assert sorted(r["message"] for r in spark.read.parquet(table).collect()) == ["a", "b"]
    land(landing, "s1", "u2", "a.jsonl", [line(3, "c", process_name="rclone.exe")])
    jobs.stream_timeline(spark, str(landing), table, ckpt).awaitTermination()
    jobs.stream_timeline(spark, str(landing), table, ckpt).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted((r["upload_id"], r["message"]) for r in rows) == [("u1", "a"), ("u1", "b"), ("u2", "c")]


def test_a_capture_in_several_batches_is_kept_whole(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    old = dict(line(1, "years before"), datetime="2019-05-01T00:00:00.000Z")
    land(landing, "s1", "u1", "a.jsonl", [line(1, "first", user="x"), line(2, "second")])
    land(landing, "s1", "u2", "a.jsonl", [line(1, "other capture")])
    jobs.stream_captures(spark, str(landing), table, ckpt).awaitTermination()
    land(landing, "s1", "u1", "b.jsonl", [line(1, "first", user="y"), line(3, "third"), old])
    land(landing, "s1", "u1", "c.jsonl", [line(3, "third")])
    jobs.stream_captures(spark, str(landing), table, ckpt).awaitTermination()
    rows = {(r["upload_id"], r["message"]): r["attrs"] for r in spark.read.parquet(table).collect()}
    assert set(rows) == {("u1", m) for m in ("first", "second", "third", "years before")} | {("u2", "other capture")}
    assert rows["u1", "first"]["user"] == "x" and spark.read.parquet(table).count() == 5


def files_of(table):
    return {str(p): p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}


def test_a_batch_adds_files_and_leaves_the_others(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    run = lambda: jobs.stream_captures(spark, str(landing), table, ckpt).awaitTermination()
    land(landing, "s1", "u1", "a.jsonl", [line(i, f"m{i}") for i in range(50)])
    run()
    first = files_of(table)
    land(landing, "s1", "u1", "b.jsonl", [line(i, f"m{i}") for i in range(45, 55)])
    run()
    second = files_of(table)
    assert first.items() <= second.items() and spark.read.parquet(table).count() == 55
    assert sum(spark.read.parquet(p).count() for p in second.keys() - first.keys()) == 5
    # The same lines again add no row; closing joins the files and keeps the rows.
    land(landing, "s1", "u1", "c.jsonl", [line(i, f"m{i}") for i in range(55)])
    run()
    before = sorted(r["id"] for r in spark.read.parquet(table).select("id").collect())
    land(landing, "s1", "u2", "a.jsonl", [line(1, "other")])
    run()
    jobs.close_captures(spark, table, [("s1", "u1")], str(tmp_path / "staging"))
    assert sorted(r["id"] for r in spark.read.parquet(table).where("upload_id = 'u1'").select("id").collect()) == before
    assert len([p for p in files_of(table) if "u1" in p]) == 1 and spark.read.parquet(table).count() == 56


def test_only_the_captures_of_a_batch_are_read(spark, tmp_path):
    table = str(tmp_path / "t")
    save_events(mapping.timeline(spark, "/root/testdata/sf0.001").drop("id"), table)
    plan = jobs.of_captures(spark.read.parquet(table), [("s1", "u3")]).select("id")._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):]
    assert "site_id" in pruned and "upload_id" in pruned and "ReadSchema: struct<id:string>" in plan


def test_a_repeat_is_dropped_while_its_capture_is_open(spark, tmp_path):
    out, ckpt = str(tmp_path / "o"), str(tmp_path / "c")

    def arrive(day, *messages):
        # The clock is in the data; "tick" moves it on.
        land(tmp_path / "in", "s", "u", f"{day}.jsonl", [line(1, m, arrived=f"2024-01-{day:02d}T00:00:00Z") for m in messages])
        events = jobs.arriving_events(spark, str(tmp_path / "in"))
        kept = jobs.dedupe_stream(events, "10 days", arrived=F.col("attrs")["arrived"].cast("timestamp"))
        kept.select("message").writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    assert arrive(1, "a", "a", "b") == ["a", "b"]
    assert arrive(2, "a", "c") == ["a", "b", "c"]
    assert arrive(9, "b") == ["a", "b", "c"]
    arrive(25, "tick")
    assert arrive(26, "a").count("a") == 2


def test_history_is_not_late(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    at = lambda day, text: dict(line(1, text), datetime=f"{day}T00:00:00.000Z")
    land(landing, "s1", "u1", "a.jsonl", [at("2024-06-01", "a")])
    jobs.stream_timeline(spark, str(landing), table, ckpt).awaitTermination()
    land(landing, "s1", "u2", "a.jsonl", [at("2023-01-01", "b"), at("2024-05-01", "c"), at("2024-06-02", "d")])
    jobs.stream_timeline(spark, str(landing), table, ckpt).awaitTermination()
    assert sorted(r["message"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c", "d"]


def test_rules_tag_a_stream(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    land(landing, "s1", "u1", "a.jsonl", [line(1, "x", process_name="rclone.exe"), line(2, "y")])
    jobs.stream_timeline(spark, str(landing), table, ckpt, rules=rule_set(spark)).awaitTermination()
    rows = {r["message"]: r["attrs"] for r in spark.read.parquet(table).collect()}
    assert rows["x"]["cloudrules_score"] == "NOTABLE" and "cloudrules_score" not in rows["y"]


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    landing, ckpt = tmp_path / "in", str(tmp_path / "c")
    out = str(tmp_path / "o")

    def run():
        windows = jobs.failure_windows(jobs.arriving_events(spark, str(landing)), "10 minutes", "10 minutes")
        writer = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    land(landing, "s", "u", "1.jsonl", [line(1, "a", event_type="logon_failed", host_name="h"), line(50, "b", event_type="logon_failed", host_name="h")])
    run()
    land(landing, "s", "u", "2.jsonl", [line(2, "late", event_type="logon_failed", host_name="h"), line(59, "c", event_type="logon_failed", host_name="h")])
    run()
    rows = {str(r["start"]): r["failures"] for r in spark.read.parquet(out).collect()}
    assert rows["2024-01-01 00:00:00"] == 1


def test_counters_work_on_a_stream(spark, tmp_path):
    landing = tmp_path / "in"
    land(landing, "s", "u", "1.jsonl", [line(1, "ran AnyDesk"), line(2, "x", event_type="t2")])
    events = jobs.arriving_events(spark, str(landing))
    query = jobs.type_counters(events).writeStream.format("memory").queryName("types").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["event_type"]: r["n"] for r in spark.table("types").collect()} == {"t": 1, "t2": 1}
    assert jobs.tool_counters(events).isStreaming
