"""What keeps the cost of a row or of a file from growing with the table."""

import glob

from pyspark.sql import functions as F

from siftline.operators import detect, inventory
from siftline.operators.rule_index import Index
from siftline.plans.catalogue import QUERIES
from siftline.plans.detection_queries import rule_set

EVENT = "id long, message string, event_type string, host_name string, data_type string, source_short string, source_long string, attrs map<string,string>"


def files(spark, *attrs):
    return spark.createDataFrame([(i, "m", "file_timeline", "h", "fs:stat:ntfs:x", "s", "l", a) for i, a in enumerate(attrs)], EVENT)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def candidates(spark, df, plugin):
    index = Index(detect.FACETS)
    plugin(rule_set(spark), index)
    some = detect.with_facets(df).select("id", F.size(F.array_distinct(detect._candidates(index))).alias("n"))
    return {r["id"]: r["n"] for r in some.collect()}


def test_tasks_that_write_definitions_grow_by_hundreds_of_files(spark, tmp_path):
    rows = [(k, f"task{k}") for k in range(1, 601)] + [(7, "task7"), (None, "no key"), (601, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    shared = f"{spark.conf.get('spark.checkpoint.dir')}/a17-*"
    before = set(glob.glob(shared))
    out = QUERIES["a17_task_files"](spark, str(tmp_path)).collect()
    assert sorted((r["message"], r["user_id"]) for r in out) == sorted((f"Scheduled Task: \\task{k} -> run.exe -n {k}", "root") for k in range(1, 601))
    (root,) = set(glob.glob(shared)) - before
    names = [p.rsplit("/", 1)[1] for p in glob.glob(f"{root}/u0/artifacts/part-*")]
    assert len(names) == 602 and len({n[:10] for n in names}) <= 3


def test_a_group_gives_only_entries_whose_literal_the_file_holds(spark):
    df = files(spark, {"file_name": "red_ring.exe", "file_path": "/c/brand11/x/"}, {"file_name": "a.sys", "file_path": "/c/x/economy/"},
               {"file_name": "mass_tool15.exe", "file_path": "/x/"}, {"file_name": "plain.dll", "file_path": "/bulk12/a/"})
    assert candidates(spark, df, detect.file_hits) == {0: 1, 1: 0, 2: 2, 3: 0}
    assert candidates(spark, df, detect.library_hits) == {0: 0, 1: 1, 2: 0, 3: 1}


def test_all_file_criteria_still_hold_whichever_opens_the_gate(spark):
    df = files(spark, {"file_name": "x.exe", "parent_path": "C:\\mass-tool3", "command_line": "y --bulk3"}, {"file_name": "x.txt", "parent_path": "C:\\mass-tool3", "command_line": "y --bulk3"},
               {"file_name": "x.dll", "task_name": "bulk_tool4"}, {"file_name": "x.dll", "task_name": "bulk_tool"}, {"file_name": "BULK_TOOL0.EXE"})
    hits = detect.detections(detect.detect(df, rule_set(spark), (detect.file_hits,)), ["id"]).collect()
    assert sorted((r["id"], r["analysis_type"]) for r in hits) == [(0, "BULK"), (2, "BULK"), (4, "BULK")]


def test_facets_that_no_test_looks_at_are_not_worked_out(spark):
    df = files(spark, {"file_name": "cold_ring.dll"}, {"file_name": "x"})
    out = detect.detections(detect.detect(df, rule_set(spark), (detect.remote_hits,)), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_f_process_stem_low" in plan and not any(f"_f_{n}#" in plan for n in ("url_host", "log_file", "command", "parent", "task", "signed"))
    assert [(r["id"], r["tool_name"]) for r in out.collect()] == [(0, "RingTool")]


def test_the_tree_reads_the_entries_once(spark, tmp_path):
    paths = ["/c/SYSVOL/a/x", "/c/SYSVOL/a/y", "/c/SYSVOL/a/x", "/c/SYSVOL/b", "rel/SYSVOL", "none", None, "/", "a//b", "/c/SYSVOL/a/"]
    spark.createDataFrame([(u, p) for u in ("u0", "u1", None) for p in paths], "upload_id string, path string").write.parquet(str(tmp_path / "e"))
    entries = spark.read.parquet(str(tmp_path / "e"))
    want = set()
    for p in filter(None, paths):
        parts = p.split("/")
        want |= {("/".join(parts[:i]), "/".join(parts[:i + 1])) for i in range(1, len(parts)) if "/".join(parts[:i])}
    got = [tuple(r) for r in inventory.ancestors(entries).collect()]
    assert len(got) == len(set(got)) and set(got) == {(u, *w) for u in ("u0", "u1", None) for w in want}
    assert final_plan(inventory.policy_tree(entries)).count("FileScan parquet") == 1
