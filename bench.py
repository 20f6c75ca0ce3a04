"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line out.

The given tables are single files of one row group, which one task must read whatever
the cluster. `value` therefore times the queries over the same rows laid out in one file
per core, as a table of that cluster would be; `one_file` has some of them over the tables
as they are. Laying out is not timed. Rules: the set of `detection_queries.rule_set`.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from siftline.plans.catalogue import QUERIES
from siftline.plans.detection_queries import FEED, rule_set
from siftline.session import local_session

HEADLINE = [
    "c01_emit", "c02_file_times", "c13_log_records", "a01_parse_timeline", "d03_search_documents", "d15_and_or_not",
    "e02_page", "e05_newest_per_group", "f04_logon_summary", "f05_files_of_directories", "f07_remote_access",
    "f16_collected_files", "f17_software_inventory", "g01_sigma_tags", "g02_file_rules", "g05_domain_rules",
    "g11_fold", "g13_session_report", "g15_signins_after_click", "c27_carry_forward",
]

ONE_FILE = ["a01_parse_timeline", "c02_file_times", "g11_fold"]


def timed(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, float]:
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    return timings


def laid_out(spark: SparkSession, sf_dir: str, scratch: str, files: int) -> str:
    """A copy of the tables in `files` files each."""
    for name in sorted(n for n in os.listdir(sf_dir) if n.endswith(".parquet")):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{scratch}/{name}")
    return scratch


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = int(cpus) if cpus.isdigit() else 8
    scratch = tempfile.mkdtemp(prefix="siftline-bench-")
    spark = local_session(cpus, shuffle_partitions=cores, shared=f"{scratch}/shared")
    split = laid_out(spark, sf_dir, f"{scratch}/tables", cores)
    # One small query first, so that JVM start-up is not charged to a headline.
    QUERIES["f01_counters"](spark, split).write.format("noop").mode("overwrite").save()
    timings = timed(spark, split, HEADLINE)
    one_file = timed(spark, sf_dir, ONE_FILE)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    # Rule throughput, next to the published events per second of conversion.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rules = rule_set(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "files_per_table": cores,
        "one_file": one_file,
        "rules": sum(map(len, (rules.files, rules.tokens, rules.events, rules.domains, rules.remote, rules.tools, rules.libraries))), "domain_feed": FEED,
        "rule_events_per_sec": round(events / timings["g11_fold"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
