"""Readers that turn capture files into record frames and line frames.

Every reader takes paths of many captures at once; `capture_pattern` pulls the
capture id out of the file path, and `with_captures` adds site, host and
collection time from the manifests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.labels import full_channel
from siftline.functions.times import event_time
from siftline.functions.values import first_non_empty, once, parse_map, parse_maps
from siftline.operators.lines import split_lines
from siftline.schema import MANIFEST_SCHEMA
from siftline.sources.texts import csv_rows, dash_rows, read_lines, read_texts, upload_of

LIVE_KINDS = [
    "processes", "connections", "dns_cache", "arp_cache", "routing_table", "logon_sessions", "user_accounts",
    "services", "startup_items", "devices", "user_accessed_data", "os_config",
]
SECTION_KINDS = [
    "file", "windowsEvent", "process", "configItem", "logonSession", "logonData", "userAccessedData", "userAccount",
    "nwConnectionDescriptor", "triggeredTask", "webArtifact", "attachedDevice", "logLine", "osConfigSetting",
]
DOCKER_KINDS = ["containers", "images", "networks", "volumes", "info"]


def file_path() -> Column:
    return F.col("_metadata.file_path")


def read_manifests(spark: SparkSession, paths: str | list[str], site_id: str = "", default_platform: str = "windows") -> DataFrame:
    """One row per capture: host (`unknown` when empty), platform, collection
    time."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(paths)
    return raw.select(
        upload_of(file_path()).alias("upload_id"), F.lit(site_id).alias("site_id"),
        F.when(F.coalesce("hostname", F.lit("")) != "", F.col("hostname")).otherwise(F.lit("unknown")).alias("host_name"),
        F.when(F.coalesce("platform", F.lit("")) != "", F.lower(F.trim("platform"))).otherwise(F.lit(default_platform)).alias("platform"),
        event_time(F.col("collection_timestamp")).alias("collection_ts"), "collector_version", "os_version", "domain",
        "collection_duration_seconds",
    )


def with_captures(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add site, host and collection time of the capture."""
    facts = manifests.select("upload_id", "site_id", "host_name", "collection_ts")
    return records.join(facts, "upload_id")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines -> records; lines that are no objects are skipped."""
    text = spark.read.text(paths).select(file_path().alias("file"), F.trim("value").alias("line"))
    return _numbered(
        text.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())
        .select(upload_of(F.col("file")).alias("upload_id"), "file", parse_map(F.col("line")).alias("rec"))
    )


def read_json_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold one JSON array, or JSON lines -> records."""
    whole = spark.read.option("wholetext", True).text(paths).select(file_path().alias("file"), F.trim("value").alias("text"))
    array = F.when(F.col("text").startswith("["), parse_maps(F.col("text")))
    lines = F.transform(F.split("text", "\r?\n"), lambda t: F.when(F.ltrim(t).startswith("{"), parse_map(t)))
    items = F.filter(F.coalesce(array, lines), lambda m: m.isNotNull())
    return _numbered(whole.select(upload_of(F.col("file")).alias("upload_id"), "file", F.explode(items).alias("rec")))


def read_live(spark: SparkSession, paths: str | list[str], kind: str | None = None) -> DataFrame:
    """Live-state arrays; `kind` is the file name without its ending where it is not
    given."""
    df = read_json_arrays(spark, paths)
    if kind is not None:
        return df.withColumn("kind", F.lit(kind))
    return df.withColumn("kind", F.regexp_extract("file", r"([^/]+)\.json$", 1)).where(F.col("kind").isin(LIVE_KINDS))


def read_fs_listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_json_lines(spark, paths)


def read_bag(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold one JSON object -> one record."""
    whole = spark.read.option("wholetext", True).text(paths)
    return _numbered(
        whole.select(file_path().alias("file"), once(parse_map(F.col("value"))).alias("rec"))
        .where(F.col("rec").isNotNull()).select(upload_of(F.col("file")).alias("upload_id"), "file", "rec")
    )


def read_sections(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """Section records `{"<type>": {...}}` -> one record frame per type."""
    rows = read_json_lines(spark, paths)
    entries = rows.select("upload_id", "file", "seq", F.explode("rec").alias("kind", "body")).where(
        F.col("kind").isin(SECTION_KINDS)
    )
    parsed = entries.withColumn("rec", once(parse_map(F.col("body")))).where(F.col("rec").isNotNull()).drop("body")
    return {f"section.{k}": parsed.where(F.col("kind") == k).drop("kind") for k in SECTION_KINDS}


def read_dash_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return dash_rows(read_lines(spark, paths))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every file below `root`: name, path in Windows form, disk path, size,
    mtime. Only metadata is read."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length", "modificationTime")
    )
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.regexp_replace("path", "^.*/" + base + "/", "")
    return raw.select(
        F.substring_index("path", "/", -1).alias("file_name"), F.translate(rel, "/", "\\").alias("path"),
        F.col("path").alias("disk_path"), rel.alias("rel"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def read_dhcp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Server log: comma-separated, heading and `#` lines skipped."""
    text = spark.read.text(paths).select(file_path().alias("file"), F.trim("value").alias("line"))
    part = F.from_csv(
        F.col("line"), "code string, date string, time string, description string, ip string, host string, mac string",
        {"mode": "PERMISSIVE"},
    )
    rows = text.where(
        (F.col("line") != "") & ~F.col("line").startswith("ID,") & ~F.col("line").startswith("#")
    ).withColumn("p", part).where(F.col("p.ip").isNotNull())
    names = ["code", "date", "time", "ip", "host", "mac"]
    flat = [c for n in names for c in (F.lit(n), F.trim(F.coalesce(F.col(f"p.{n}"), F.lit(""))))]
    flat += [F.lit("file"), F.substring_index("file", "/", -1)]
    return _numbered(rows.select(upload_of(F.col("file")).alias("upload_id"), F.create_map(*flat).alias("rec")))


def read_mail(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Mail-security CSV exports, each with its own heading; the columns decide the
    kind."""
    return csv_rows(read_lines(spark, paths)).select("upload_id", "rec", "seq")


def read_cloud(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_json_arrays(spark, paths)


def read_sshd_journal(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_json_lines(spark, paths)


def read_unified_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_json_lines(spark, paths)


def read_docker(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Container, image, network and volume lists (JSON lines) or the info bag."""
    if kind not in DOCKER_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return read_bag(spark, paths) if kind == "info" else read_json_lines(spark, paths)


def read_packages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Package listings, one text per manager -> line frame with `manager`."""
    bag = read_bag(spark, paths)
    blocks = F.explode(parse_maps(F.col("rec")["managers"]))
    texts = bag.select("upload_id", "file", "seq", blocks.alias("m")).select(
        "upload_id", "seq", F.concat("file", F.lit("#"), F.col("m")["manager"]).alias("file"),
        F.col("m")["manager"].alias("manager"), F.coalesce(F.col("m")["raw"], F.lit("")).alias("text"),
    )
    return split_lines(texts)


TASK_SCHEMA = T.StructType([
    T.StructField("RegistrationInfo", T.StructType([
        T.StructField(n, T.StringType()) for n in ("Date", "Author", "Description", "URI")
    ])),
    T.StructField("Actions", T.StructType([T.StructField("Exec", T.ArrayType(T.StructType([
        T.StructField("Command", T.StringType()), T.StructField("Arguments", T.StringType()),
    ])))])),
    T.StructField("Principals", T.StructType([T.StructField("Principal", T.ArrayType(T.StructType([
        T.StructField("UserId", T.StringType()), T.StructField("RunLevel", T.StringType()),
    ])))])),
])


def read_tasks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Task definition files: registration, first action, principal. Files that
    do not parse give NULL fields and no event."""
    texts = read_texts(spark, paths)
    parsed = texts.withColumn("t", F.from_xml("text", TASK_SCHEMA.simpleString(), {"mode": "PERMISSIVE"}))
    action, who = F.get("t.Actions.Exec", F.lit(0)), F.get("t.Principals.Principal", F.lit(0))
    fields = {
        "date": F.col("t.RegistrationInfo.Date"), "author": F.col("t.RegistrationInfo.Author"),
        "description": F.col("t.RegistrationInfo.Description"), "uri": F.col("t.RegistrationInfo.URI"),
        "command": action["Command"], "arguments": action["Arguments"], "user_id": who["UserId"],
        "run_level": who["RunLevel"], "file_name": F.substring_index("file", "/", -1),
        "file_path": F.regexp_replace("file", "/[^/]*$", ""),
    }
    flat = [c for k, v in fields.items() for c in (F.lit(k), F.coalesce(v, F.lit("")))]
    return parsed.select("upload_id", "seq", F.create_map(*flat).alias("rec"))


def read_sigma(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sigma results: record id under either key, short channel names expanded,
    techniques from a text, a list, or the `attack.` tags."""
    df = read_json_lines(spark, paths)
    rec = F.col("rec")
    record = first_non_empty(rec["RecordID"], rec["EvtxRecordId"])
    listed = F.from_json(rec["MitreAttack"], "array<string>")
    tags = F.filter(F.from_json(rec["Tags"], "array<string>"), lambda t: t.startswith("attack."))
    mitre = (
        F.when(rec["MitreAttack"].startswith("["), F.array_join(F.filter(listed, lambda t: t != ""), ", "))
        .when(rec["MitreAttack"].isNotNull(), rec["MitreAttack"]).otherwise(F.array_join(tags, ", "))
    )
    return df.where(record.isNotNull()).select(
        "upload_id", full_channel(F.coalesce(rec["Channel"], F.lit(""))).alias("channel"), record.alias("record_number"),
        "seq", F.coalesce(rec["RuleTitle"], F.lit("")).alias("title"), F.coalesce(rec["RuleID"], F.lit("")).alias("rule_id"),
        F.lower(F.coalesce(rec["Level"], F.lit(""))).alias("level"), F.coalesce(mitre, F.lit("")).alias("mitre"),
        rec["Status"].alias("status"), rec["Details"].alias("details"), rec["Computer"].alias("computer"),
        rec["EventID"].alias("event_id"), rec["Timestamp"].alias("timestamp"),
    )


def write_report(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Sorted CSV report with a heading. The sort is a range partitioning, so
    the parts follow each other in file-name order."""
    df.orderBy(*order).write.mode(mode).option("header", True).csv(path)
