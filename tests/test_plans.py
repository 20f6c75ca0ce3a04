"""Shapes the physical plans must keep, and properties of paging and dedupe."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import build, correlate, filters, paging, summaries
from siftline.operators.detect import detect
from siftline.operators.lines import carry_forward
from siftline.plans import mapping
from siftline.plans.catalogue import QUERIES
from siftline.plans.detection_queries import rule_set
from siftline.sources.timeline import save_events

SF = "/root/testdata/sf0.001"
MANY_PASSES = {"c07_resolve_paths", "c03_mft_events"} | {n for n in QUERIES if n.startswith("j")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MANY_PASSES))
def test_no_cross_or_nested_loop_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert shape not in plan


def test_detection_needs_no_shuffle(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select(
        "event_id", F.lit("h").alias("host_name"), F.lit("m").alias("message"), "event_type", F.lit("x").alias("data_type"),
        F.lit("s").alias("source_short"), F.lit("l").alias("source_long"), F.create_map(F.lit("process_name"), F.col("event_type")).alias("attrs"),
    )
    assert "Exchange" not in plan_of(detect(df, rule_set(spark)))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    save_events(mapping.timeline(spark, SF).drop("id"), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    events = spark.read.parquet(path)
    chosen = filters.query_events(events, site="s1", event_types=["windows_logon"], channel="Security", start="2024-01-02").select("id")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and "EqualTo(channel,Security)" in plan and "EqualTo(event_type,windows_logon)" in plan
    read = plan[plan.index("ReadSchema"):]
    assert "attrs" not in read and "message" not in read


def test_dedupe_combines_before_the_shuffle(spark):
    df = mapping.timeline(spark, SF)
    plan = plan_of(build.emit(df))
    assert "partial_min_by" in plan and "Window [" not in plan


def test_pages_cover_the_sorted_set(spark):
    df = filters.query_events(mapping.timeline(spark, SF), event_types=["windows_logon"])
    whole = [r["id"] for r in paging.sort_events(df).collect()]
    pages, offset = [], 0
    while offset < len(whole):
        pages += [r["id"] for r in paging.page(df, offset, 100).collect()]
        offset += 100
    assert pages == whole
    assert paging.page(df, 0, 5000).count() == min(5000, len(whole))


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, message string").withColumn("datetime", F.lit(0).cast("timestamp"))
    assert [r["id"] for r in paging.sort_events(df, "message", "asc").collect()] == [2, 3, 1]
    assert [r["id"] for r in paging.sort_events(df, "message", "desc").collect()] == [1, 3, 2]


def test_not_drops_rows_without_the_field(spark):
    df = spark.createDataFrame([(1, {"f": "v"}), (2, {"f": "w"}), (3, {})], "id long, attrs map<string,string>")
    assert [r["id"] for r in filters.where_events(df, {"not": {"field": "f", "eq": "v"}}).collect()] == [2]


def test_wildcards_in_values_are_literal(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "500 off")], "id long, message string").withColumn("attrs", F.expr("map('a','b')"))
    assert [r["id"] for r in filters.where_events(df, {"field": "message", "contains": "50%"}).collect()] == [1]
    assert [r["id"] for r in filters.query_events(df, text="0% o").collect()] == [1]


def test_carry_forward_does_not_depend_on_the_chunk(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("n"))
    value = F.when(F.col("n") % 37 == 0, F.col("n"))
    results = [
        [tuple(r) for r in carry_forward(df, ["g"], "n", value, "v", chunk=c).orderBy("n").select("n", "v").collect()] for c in (1, 10, 5000)
    ]
    assert results[0] == results[1] == results[2] == [(i, i // 37 * 37) for i in range(1000)]


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_latest_before_is_exact_on_one_hot_key(spark, chunk):
    left = spark.range(200).select(F.lit("k").alias("user"), F.col("id"), (F.col("id") * 3).alias("micros"))
    right = spark.range(60).select(F.lit("k").alias("user"), (F.col("id") * 11 + 1).alias("micros"))
    got = {r["id"]: r["match_micros"] for r in correlate.latest_before(left, right, ["user"], within=5, chunk=chunk).collect()}
    times = [i * 11 + 1 for i in range(60)]
    want = {}
    for i in range(200):
        best = max((t for t in times if t <= i * 3), default=None)
        if best is not None and i * 3 - best <= 5:
            want[i] = best
    assert got == want


def test_first_matching_tool_wins(spark):
    df = spark.createDataFrame([("uses psexec then AnyDesk",), ("vnc",), ("none",)], "message string")
    names = [summaries.REMOTE_TOOLS[r["t"]][0] if r["t"] is not None else None for r in df.select(summaries.remote_tool(F.col("message")).alias("t")).collect()]
    assert names == ["AnyDesk", "VNC (various)", None]


def test_jump_window_does_not_leave_the_day():
    assert filters.jump_window("2024-01-10", "10:15") == ("2024-01-10 10:15:00", "2024-01-10 11:15:59")
    assert filters.jump_window("2024-01-10", "23:15") == ("2024-01-10 23:15:00", "2024-01-10 23:15:59")


def test_events_without_a_record_number_are_kept_by_the_sigma_join(spark):
    from siftline.operators.detect import tag_sigma

    df = spark.createDataFrame(
        [("u", 1, "a", {"channel": "Security", "record_number": "5"}), ("u", 2, "b", {})],
        "upload_id string, seq long, message string, attrs map<string,string>",
    )
    found = spark.createDataFrame(
        [("u", "Security", "5", i, t, r, "low", "") for i, (t, r) in enumerate([("A", "r1"), ("B", "r2"), ("A", "r1")])],
        "upload_id string, channel string, record_number string, seq long, title string, rule_id string, level string, mitre string",
    )
    rows = {r["seq"]: r for r in tag_sigma(df, found).collect()}
    assert set(rows) == {1, 2} and rows[2]["tags"] == []
    assert rows[1]["attrs"]["hayabusa_detection_count"] == "3" and rows[1]["attrs"]["hayabusa_rule"] == "A; B"
