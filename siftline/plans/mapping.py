"""Timelines derived from the test tables.

One SELECT per timeline, readable by Spark and by the checking engine; only the
JSON access differs (`{k}`). Each is wrapped into an event frame for Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.values import drop_empty, once, raw_map

SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
DUCK_K = "CAST(props->>'$.k' AS INT)"

EVENTS = """
SELECT event_id AS id, event_id AS seq, ts, user_id, event_type AS kind, value, {k} AS k FROM {events}
"""

TIMELINE = """
SELECT id, seq, k, user_id, kind,
  'u' || CAST(user_id % 8 AS STRING) AS upload_id, 's' || CAST(user_id % 2 AS STRING) AS site_id,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'host' || CAST(user_id % 8 AS STRING) END AS host_name,
  date_trunc('MILLISECOND', ts) AS datetime,
  CASE WHEN k % 2 = 0 THEN 'Event Log Entry' ELSE 'Windows Event Log Entry' END AS timestamp_desc,
  kind || ' by user' || CAST(user_id AS STRING) AS message,
  CASE kind WHEN 'view' THEN 'windows_logon' WHEN 'error' THEN 'windows_logon' WHEN 'click' THEN 'windows_process'
    WHEN 'signup' THEN 'account_created' ELSE 'active_connection' END AS event_type,
  'windows:evtx:record' AS data_type, 'CT-EventLog' AS source_short, 'EVTX - Security' AS source_long,
  CASE WHEN k % 13 = 0 THEN 'LikelyNotable' WHEN k % 13 = 1 THEN 'LikelyNotable,Unknown' END AS ct_significance,
  value > 200 AS is_suspicious,
  CASE WHEN k % 17 = 0 THEN 'bad' WHEN k % 19 = 0 THEN 'suspicious' END AS finding,
  CASE WHEN k % 17 = 0 THEN 'note ' || CAST(k AS STRING) END AS finding_note,
  CASE kind WHEN 'view' THEN '4624' WHEN 'error' THEN '4625' WHEN 'click' THEN '4688' WHEN 'signup' THEN '4720'
    ELSE '5156' END AS event_identifier,
  CASE kind WHEN 'signup' THEN 'System' WHEN 'purchase' THEN 'Microsoft-Windows-Sysmon/Operational'
    ELSE 'Security' END AS channel,
  'user' || CAST(user_id AS STRING) || CASE WHEN user_id % 10 = 0 THEN '$' ELSE '' END AS TargetUserName,
  CASE WHEN k % 7 = 0 THEN '-' WHEN k % 11 = 0 THEN NULL ELSE '10.0.0.' || CAST(k AS STRING) END AS IpAddress,
  CASE k % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '10' ELSE '5' END AS LogonType,
  CASE k % 3 WHEN 0 THEN 'NTLM' WHEN 1 THEN 'Kerberos' END AS AuthenticationPackageName,
  CASE WHEN user_id % 6 = 0 THEN '-' WHEN user_id % 3 = 1 THEN 'DOM' || CAST(k % 5 AS STRING) END AS TargetDomainName,
  CAST(user_id * 1000 + EXTRACT(DAY FROM ts) AS STRING) AS TargetLogonId,
  CAST(user_id % 20 AS STRING) AS SessionID,
  CASE WHEN k % 3 = 0 THEN 'svc' || CAST(k % 5 AS STRING) END AS param1,
  CASE WHEN k % 2 = 0 THEN 'running' ELSE 'stopped' END AS param2,
  CASE WHEN kind = 'click' THEN CASE k % 4 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'rclone.exe'
    ELSE 'AnyDesk.exe' END END AS process_name,
  CASE WHEN kind = 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'C:\\Users\\u\\AppData\\Local\\Temp\\' ELSE 'C:\\Windows\\System32\\' END
    || CASE k % 4 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'rclone.exe' ELSE 'AnyDesk.exe' END END AS process_path,
  CASE WHEN kind = 'click' THEN CASE k % 5 WHEN 0 THEN 'run -EncodedCommand ' WHEN 1 THEN 'run -nop -w hidden ' ELSE 'run ' END
    || CAST(k AS STRING) END AS command_line,
  CAST(id AS STRING) AS record_number
FROM ({events_sql}) e
"""

TIMELINE_ATTRS = [
    "event_identifier", "channel", "TargetUserName", "IpAddress", "LogonType", "AuthenticationPackageName",
    "TargetDomainName", "TargetLogonId", "SessionID", "param1", "param2", "process_name", "process_path",
    "command_line", "record_number",
]

SESSIONS = """
SELECT id, seq, k, user_id, 'u' || CAST(user_id % 8 AS STRING) AS upload_id, 's0' AS site_id,
  'host' || CAST(user_id % 8 AS STRING) AS host_name, date_trunc('MILLISECOND', ts) AS datetime,
  'Event Log Entry' AS timestamp_desc, kind AS message,
  CASE WHEN kind IN ('view', 'error') THEN 'windows_logon' WHEN kind IN ('click', 'purchase') THEN 'windows_rdp'
    ELSE 'rdp_connection' END AS event_type,
  'windows:evtx:record' AS data_type, 'CT-EVTX' AS source_short, 'EVTX' AS source_long,
  CAST(NULL AS STRING) AS ct_significance, FALSE AS is_suspicious,
  CASE WHEN kind = 'view' AND k % 2 = 0 THEN '4624' WHEN kind = 'view' AND k % 3 = 0 THEN '4647' WHEN kind = 'view' THEN '4634'
    WHEN kind = 'error' AND k % 3 = 0 THEN '4625' WHEN kind = 'error' THEN '4672' WHEN kind = 'click' THEN '21'
    WHEN kind = 'purchase' THEN '23' END AS event_identifier,
  CASE WHEN kind IN ('view', 'error') THEN CAST(user_id * 100 + k % 3 AS STRING) END AS TargetLogonId,
  CASE WHEN kind <> 'signup' AND k % 6 <> 5 THEN CAST(user_id AS STRING) END AS SessionID,
  CASE WHEN kind IN ('view', 'error') THEN 'user' || CAST(user_id AS STRING) END AS TargetUserName,
  CASE WHEN kind IN ('view', 'error') AND user_id % 2 = 0 THEN 'DOM' END AS TargetDomainName,
  CASE WHEN kind IN ('click', 'purchase') THEN 'DOM\\user' || CAST(user_id + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END AS STRING) END AS user_name,
  CASE WHEN kind IN ('click', 'purchase') AND k % 4 = 0 THEN 'LOCAL' END AS Address,
  CASE WHEN kind IN ('view', 'error') THEN CASE WHEN k % 7 = 0 THEN '-' WHEN k % 11 = 0 THEN NULL ELSE '10.0.0.' || CAST(k AS STRING) END END AS IpAddress,
  CASE WHEN kind IN ('view', 'error') THEN CASE k % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '10' ELSE '5' END END AS LogonType,
  CASE WHEN k % 3 = 0 THEN 'ws' || CAST(k AS STRING) END AS WorkstationName,
  CASE WHEN kind = 'signup' THEN 'server' || CAST(k % 3 AS STRING) END AS entries,
  CASE WHEN kind = 'signup' AND k % 2 = 0 THEN 'remote' || CAST(user_id AS STRING) END AS username,
  CASE WHEN kind = 'signup' THEN 'local' || CAST(user_id AS STRING) END AS local_user
FROM ({events_sql}) e
"""

SESSION_ATTRS = [
    "event_identifier", "TargetLogonId", "SessionID", "TargetUserName", "TargetDomainName", "Address", "IpAddress",
    "LogonType", "WorkstationName", "entries", "username", "local_user",
]

FILES = """
SELECT (l_orderkey * 100000 + l_partkey) * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT) AS id,
  (l_orderkey * 100000 + l_partkey) * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT) AS seq,
  'u' || CAST(l_suppkey % 5 AS STRING) AS upload_id, 's0' AS site_id, 'host' AS host_name,
  l_shipdate AS datetime, l_partkey, l_suppkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN 'File Modified' WHEN 1 THEN 'File Created' WHEN 2 THEN 'File Accessed'
    ELSE 'MFT Entry Changed' END || CASE WHEN l_returnflag = 'R' THEN ' ($FN)' ELSE '' END AS timestamp_desc,
  'File: ' || p_name AS message,
  CASE WHEN l_returnflag = 'R' THEN 'file_timeline_fn' ELSE 'file_timeline' END AS event_type,
  CASE WHEN l_returnflag = 'R' THEN 'fs:stat:ntfs:$file_name' ELSE 'fs:stat:ntfs:$standard_information' END AS data_type,
  'CT-MFT' AS source_short, 'MFT' AS source_long,
  CASE WHEN l_suppkey % 7 = 0 THEN 'LikelyNotable' END AS ct_significance, l_tax > 0.06 AS is_suspicious,
  CASE WHEN l_linenumber = 7 THEN CASE l_suppkey % 3 WHEN 0 THEN '/c/' WHEN 1 THEN '/d/' ELSE '/e/' END
    ELSE '/c/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' END AS file_path,
  replace(p_name, ' ', '_') || CASE l_partkey % 6 WHEN 0 THEN '.exe' WHEN 1 THEN '.dll' WHEN 2 THEN '.SYS'
    WHEN 3 THEN '.txt' WHEN 4 THEN '.tar.gz' ELSE '' END AS file_name,
  CAST(CAST(l_quantity AS INT) * 1000 AS STRING) AS file_size,
  CASE WHEN l_partkey % 5 = 0 THEN md5(p_name) END AS md5,
  CASE WHEN l_suppkey % 9 = 0 THEN 'true' END AS is_deleted,
  CASE WHEN l_partkey % 50 = 0 THEN 'Dir' WHEN l_partkey % 3 = 0 THEN 'File' END AS meta_type,
  CASE WHEN l_partkey % 4 = 0 THEN 'Collected' END AS file_content_status,
  CASE WHEN l_returnflag = 'R' THEN 'Compare' END AS timestompNote
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

FILE_ATTRS = [
    "file_path", "file_name", "file_size", "md5", "is_deleted", "meta_type", "file_content_status", "timestompNote",
]

PAGES = """
SELECT page_id AS id, page_id AS seq, 'u0' AS upload_id, 's0' AS site_id, 'host' AS host_name,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS datetime, 'URL Visited' AS timestamp_desc, 'Visited' AS message,
  'web_visit' AS event_type, 'ct:web:artifact' AS data_type, 'CT-WebArtifact' AS source_short, 'Web' AS source_long,
  CAST(NULL AS STRING) AS ct_significance, FALSE AS is_suspicious, url,
  CASE WHEN page_id % 4 = 0 THEN 'a.b.mega.example' WHEN page_id % 4 = 1 THEN 'mega.example' END AS domain,
  CASE WHEN page_id % 5 = 0 THEN 'files.transfer.test' END AS remote_host,
  CAST(page_id % 3 * 443 AS STRING) AS remote_port
FROM {pages}
"""

PAGE_ATTRS = ["url", "domain", "remote_host", "remote_port"]

BASE = [
    "id", "seq", "upload_id", "site_id", "host_name", "datetime", "timestamp_desc", "message", "event_type",
    "data_type", "source_short", "source_long", "ct_significance", "is_suspicious",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    frames = {t: read(spark, sf_dir, t) for t in tables}
    text = sql.replace("{events_sql}", EVENTS).replace("{k}", SPARK_K).replace("\\", "\\\\")
    return spark.sql(text, **frames)


def _frame(df: DataFrame, attrs: list[str], extra: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    rename = rename or {}
    pairs: dict[str, Column] = {rename.get(a, a): F.col(a) for a in attrs}
    wide = df.withColumn("_raw", once(raw_map(pairs)))
    return wide.select(
        *[F.col(c).cast("timestamp").alias(c) if c == "datetime" else F.col(c) for c in BASE],
        *extra, drop_empty(F.col("_raw")).alias("attrs"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, EVENTS, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows log timeline out of `events`."""
    df = _run(spark, sf_dir, TIMELINE, "events")
    return _frame(df, TIMELINE_ATTRS, ["k", "user_id", "finding", "finding_note"])


def session_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon, terminal and registry session events out of `events`."""
    df = _run(spark, sf_dir, SESSIONS, "events")
    return _frame(df, [*SESSION_ATTRS, "user_name"], rename={"user_name": "User"})


def file_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File times out of `lineitem` and `part`."""
    return _frame(_run(spark, sf_dir, FILES, "lineitem", "part"), FILE_ATTRS, ["l_partkey", "l_suppkey"])


def web_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits out of `pages`."""
    return _frame(_run(spark, sf_dir, PAGES, "pages"), PAGE_ATTRS)


def _duck(sql: str) -> str:
    out = sql.replace("{events_sql}", EVENTS).replace("{k}", DUCK_K)
    for t in ("events", "lineitem", "part", "pages"):
        out = out.replace("{" + t + "}", t)
    return out.replace("AS STRING", "AS VARCHAR").strip()


WITH_EVENTS = f"WITH ev AS ({_duck(EVENTS)})"
WITH_TIMELINE = f"WITH tl AS ({_duck(TIMELINE)})"
WITH_SESSIONS = f"WITH st AS ({_duck(SESSIONS)})"
WITH_FILES = f"WITH ft AS ({_duck(FILES)})"
WITH_PAGES = f"WITH wt AS ({_duck(PAGES)})"
