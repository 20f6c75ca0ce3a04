"""Kept summaries follow the captures that change, and fold to the full result."""

from pyspark.sql import functions as F

from siftline.operators import filters, kept, summaries
from siftline.plans import mapping
from siftline.sources.timeline import add_events, save_events

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_only_changed_captures_are_renewed(spark, tmp_path):
    df, table, store = mapping.timeline(spark, SF), str(tmp_path / "t"), str(tmp_path / "s")
    save_events(df.where("upload_id <> 'u7'"), table)
    first = kept.refresh(spark, table, store)
    assert len(first) == len(set(first)) > 6 and kept.refresh(spark, table, store) == []
    add_events(df.where("upload_id = 'u7'"), table)
    assert kept.refresh(spark, table, store) == [("s1", "u7")]
    # A capture that loses its logons loses its rows.
    save_events(df.where("upload_id = 'u7' AND event_type = 'windows_process'"), table)
    assert kept.refresh(spark, table, store) == [("s1", "u7")]
    assert kept.states(spark, store, "logons", "s1", "u7").count() == 0
    whole = spark.read.parquet(table)
    names = ["username", "total_events", "success_count", "fail_count", "unique_ips", "first_seen", "last_seen", "auth_packages", "logon_types"]
    for site, upload in ((None, None), ("s0", None), ("s1", "u3")):
        some = whole.where((F.col("site_id") == site) if site else F.lit(True)).where((F.col("upload_id") == upload) if upload else F.lit(True))
        assert rows(kept.kept_logons(kept.states(spark, store, "logons", site, upload)), *names) == rows(summaries.logon_summary(some), *names)
        types = some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        assert rows(kept.kept_types(kept.states(spark, store, "types", site, upload)), "event_type", "n") == rows(types, "event_type", "n")
        tools = ["tool_name", "category", "event_count", "event_types", "first_seen", "last_seen"]
        assert rows(kept.cached_remote_access(spark, table, store, site, upload), *tools) == rows(summaries.remote_access(some), *tools)


def test_a_read_touches_the_store_alone(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    save_events(mapping.timeline(spark, SF), table)
    kept.refresh(spark, table, store)
    plan = kept.kept_logons(kept.states(spark, store, "logons", "s1", "u3"))._jdf.queryExecution().executedPlan().toString()
    assert table not in plan and "PartitionFilters: [isnotnull(site_id" in plan
    stamp = kept.stamps(spark.read.parquet(table))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in stamp


def test_search_reads_only_captures_that_may_match(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = mapping.timeline(spark, SF)
    odd = df.limit(1).withColumns({"upload_id": F.lit("odd"), "message": F.lit("Une CAFÉ-crème 50% off the_menu"), "attrs": F.create_map(F.lit("MiXed"), F.lit("x\\y.exe"))})
    save_events(df.unionByName(odd), table)
    events = spark.read.parquet(table)
    for query in ("dom3", "by user1", "café", "50% off", "% o", "crème café", "fé-cr", "the_menu", "mixed", "x\\y", "y.exe", "nothing like it", "the", "ab", "user12 view"):
        want = rows(events.where(filters.search(events, query)), "id")
        assert rows(kept.search_events(spark, table, store, query), "id") == want, query
    assert rows(kept.search_events(spark, table, store, "café", "s0"), "id") == rows(events.where(filters.search(events, "café") & (F.col("site_id") == "s0")), "id")
    plan = kept.search_events(spark, table, store, "café")._jdf.queryExecution().executedPlan().toString()
    filters_ = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "odd" in filters_ and "u3" not in filters_
