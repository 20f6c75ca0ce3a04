"""Event builders over whole tables: records are derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.times import iso_ms
from siftline.functions.values import attribute_map
from siftline.operators import browsers, files, linux, live, macos, records, registry, sections, windows
from siftline.operators.build import emit, run_all
from siftline.operators.lines import blocks, carry_forward
from siftline.plans.mapping import WITH_EVENTS, WITH_FILES, file_timeline, raw_events, read
from siftline.plans.registry import query

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"
COLLECTED = "2024-02-01T00:00:00.000Z"


def as_records(df: DataFrame, fields: dict, upload=None, keep: tuple = ()) -> DataFrame:
    """Record frame with one capture key and a fixed collection time."""
    return df.select(
        (upload if upload is not None else F.lit("u0")).alias("upload_id"), F.lit("s0").alias("site_id"),
        F.lit("host").alias("host_name"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("collection_ts"),
        F.col("seq").cast("long").alias("seq"), *keep, attribute_map(fields).alias("rec"),
    )


def shown(df: DataFrame, *extra) -> DataFrame:
    return df.select("seq", iso_ms(F.col("datetime")).alias("at"), "timestamp_desc", "message", "event_type", *extra)


# ------------------------------------------------------------------ unpivots

_MACB = f"""WITH r AS (SELECT o_orderkey AS seq, o_orderdate AS d, o_orderstatus AS st FROM orders),
u AS (SELECT seq, st, unnest([d, d + INTERVAL 1 DAY, CASE WHEN seq % 3 = 0 THEN d + INTERVAL 2 DAY END, d + INTERVAL 3 DAY]) AS w,
 unnest(['File Modified', 'File Created', 'File Accessed', 'MFT Entry Changed']) AS kind, FALSE AS fn FROM r
 UNION ALL SELECT seq, st, unnest([d, CASE WHEN seq % 5 = 0 THEN d END]) AS w, unnest(['File Modified ($FN)', 'File Created ($FN)']) AS kind, TRUE AS fn FROM r)
SELECT seq, strftime(w, '{ISO}') AS at, kind AS timestamp_desc, CASE WHEN seq % 7 = 0 THEN 'Directory' WHEN st = 'F' THEN 'File (hashed)' ELSE 'File' END
 || CASE WHEN fn THEN ' ($FN)' ELSE '' END || ': /c/o' || seq AS message, CASE WHEN fn THEN 'file_timeline_fn' ELSE 'file_timeline' END AS event_type,
 CASE WHEN fn THEN 'Compare with SI timestamps for timestomping detection' END AS note FROM u WHERE w IS NOT NULL"""


@query("c02_file_times", _MACB)
def file_times(spark, sf):
    key, day = F.col("o_orderkey"), 86400000
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    orders = read(spark, sf, "orders").withColumn("seq", key)
    recs = as_records(orders, {
        "fullPath": F.concat(F.lit("/c/o"), key.cast("string")), "metaType": F.when(key % 7 == 0, F.lit("Dir")),
        "md5hash": F.when(F.col("o_orderstatus") == "F", F.lit("x")), "dateModified": ms, "dateCreated": ms + day,
        "dateAccessed": F.when(key % 3 == 0, ms + 2 * day), "dateChanged": ms + 3 * day, "fn_dateModified": ms,
        "fn_dateCreated": F.when(key % 5 == 0, ms),
    })
    return shown(files.file_records(recs), F.col("attrs")["timestompNote"].alias("note"))


@query("c04_listing_times", f"""WITH u AS (SELECT o_orderkey AS seq, unnest([o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 DAY]) AS w,
 unnest(['File Modified', 'File Accessed', 'File Created']) AS timestamp_desc FROM orders)
SELECT seq, strftime(w, '{ISO}') AS at, timestamp_desc, CASE WHEN seq % 7 = 0 THEN 'Directory: ' ELSE 'File: ' END || '/o' || seq AS message, 'file_timeline' AS event_type FROM u WHERE w IS NOT NULL""")
def listing_times(spark, sf):
    key, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    recs = as_records(read(spark, sf, "orders").withColumn("seq", key), {
        "path": F.concat(F.lit("/o"), key.cast("string")), "is_directory": (key % 7 == 0), "modified": iso_ms(d),
        "accessed": F.when(key % 2 == 0, iso_ms(d)), "created": iso_ms(F.date_sub(d, 1).cast("timestamp")),
    })
    return shown(files.file_listing(recs))


@query("c05_devices", f"""WITH u AS (SELECT o_orderkey AS seq, unnest([o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate + INTERVAL 2 DAY]) AS w,
 unnest(['Device First Connected', 'Device Last Connected', 'Device Last Disconnected']) AS timestamp_desc, unnest(['first connected', 'last connected', 'last disconnected']) AS verb FROM orders)
SELECT seq, strftime(w, '{ISO}') AS at, timestamp_desc, 'Device ' || verb || ': USB v' || (seq % 5) || CASE WHEN seq % 3 = 0 THEN ' (S/N: ' || seq || ')' ELSE '' END AS message, 'attached_device' AS event_type FROM u WHERE w IS NOT NULL""")
def devices(spark, sf):
    key, day = F.col("o_orderkey"), 86400000
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    recs = as_records(read(spark, sf, "orders").withColumn("seq", key), {
        "busType": F.lit("USB"), "vendorId": F.concat(F.lit("v"), (key % 5).cast("string")),
        "serialNum": F.when(key % 3 == 0, key), "firstConnectTime": ms,
        "lastConnectTime": F.when(key % 2 == 0, ms + day), "lastDisconnectTime": ms + 2 * day,
    })
    return shown(sections.attached_devices(recs))


@query("c06_prefetch", f"""WITH u AS (SELECT o_orderkey AS seq, o_custkey, unnest([o_orderdate, o_orderdate + INTERVAL 1 HOUR, TIMESTAMP '1960-01-01 00:00:00']) AS w FROM orders)
SELECT seq, strftime(w, '{ISO}') AS at, 'Prefetch Execution Time' AS timestamp_desc, 'Program executed: APP' || (seq % 10) || CASE WHEN o_custkey % 4 > 0 THEN ' (run count: ' || (o_custkey % 4) || ')' ELSE '' END AS message, 'prefetch_execution' AS event_type FROM u WHERE w > TIMESTAMP '1970-01-01 00:00:00'""")
def prefetch(spark, sf):
    key, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    runs = F.to_json(F.array(iso_ms(d), iso_ms(F.timestamp_millis(F.unix_millis(d) + 3600000)), F.lit("1960-01-01T00:00:00.000Z")))
    recs = as_records(read(spark, sf, "orders").withColumn("seq", key), {
        "executable": F.concat(F.lit("APP"), (key % 10).cast("string")), "run_count": F.col("o_custkey") % 4, "last_run_times": runs,
    })
    return shown(files.prefetch(recs))


# --------------------------------------------------------------- MFT and paths

def _entries(spark, sf):
    """Part keys as a file tree (parent = key / 2, roots at record 5), with
    extension records, a broken chain and a cycle."""
    key = F.col("p_partkey").cast("long")
    base = key * 2 + 1000
    up = F.when(key < 2, F.lit(5)).otherwise(F.call_function("div", key, F.lit(2).cast("long")) * 2 + 1000)
    up = F.when(key == 100, F.lit(7)).when(key == 101, F.lit(404 * 2 + 1000)).otherwise(up)
    stamp = F.timestamp_seconds(F.lit(1700000000) + key)
    own_name = key % 4 != 1
    common = lambda names, si: [
        F.lit("u0").alias("upload_id"), F.lit("C").alias("volume"),
        F.when(names, F.concat(F.lit("f"), key.cast("string"))).alias("file_name"), up.alias("parent_ref"),
        F.when(key % 3 == 0, F.lit(3)).otherwise(F.lit(1)).cast("long").alias("flags"),
        F.lit(10).cast("long").alias("file_size"), names.alias("has_fn"), si.alias("has_si"),
        *[F.when(si, stamp).alias(f"si_{k}") for k in ("modified", "created", "accessed", "changed")],
        *[F.when(names, F.when(key % 6 == 0, F.lit("1979-01-01").cast("timestamp")).otherwise(stamp)).alias(f"fn_{k}") for k in ("modified", "created", "accessed", "changed")],
    ]
    part = read(spark, sf, "part")
    own = part.select(base.alias("record_num"), F.lit(0).cast("long").alias("base_ref"), *common(own_name, F.lit(True)))
    ext = part.where(~own_name).select((base + 1000000).alias("record_num"), base.alias("base_ref"), *common(F.lit(True), F.lit(False)))
    return own.unionByName(ext)


_TREE = """WITH RECURSIVE t AS (SELECT p_partkey AS key, '\\f' || p_partkey AS path FROM part WHERE p_partkey <= 1
 UNION ALL SELECT p_partkey, t.path || '\\f' || p_partkey FROM part JOIN t ON p_partkey // 2 = t.key WHERE p_partkey > 1 AND p_partkey NOT IN (100, 101))"""


@query("c07_resolve_paths", f"{_TREE} SELECT key, 'C:' || path AS path FROM t")
def resolve_paths(spark, sf):
    base = files.merge_extension_records(_entries(spark, sf))
    paths = files.resolve_paths(base, ["upload_id", "volume"], "record_num", "parent_ref", "file_name")
    key = F.call_function("div", F.col("node") - 1000, F.lit(2).cast("long"))
    return paths.select(key.alias("key"), F.concat(F.lit("C:\\"), "path").alias("path"))


@query("c08_merge_extensions", """SELECT p_partkey AS key, 'f' || p_partkey AS file_name, TRUE AS has_si, TRUE AS has_fn FROM part""")
def merge_extensions(spark, sf):
    base = files.merge_extension_records(_entries(spark, sf))
    key = F.call_function("div", F.col("record_num") - 1000, F.lit(2).cast("long"))
    return base.select(key.alias("key"), "file_name", "has_si", "has_fn")


@query("c03_mft_events", f"""{_TREE}, u AS (SELECT key, path, unnest(['File Modified', 'File Created', 'File Accessed', 'MFT Entry Changed', 'File Modified ($FN)', 'File Created ($FN)', 'File Accessed ($FN)', 'MFT Entry Changed ($FN)']) AS kind FROM t)
SELECT strftime(make_timestamp((1700000000 + key) * 1000000), '{ISO}') AS at, kind AS timestamp_desc, CASE WHEN key % 3 = 0 THEN 'Directory' ELSE 'File' END || CASE WHEN kind LIKE '%FN)' THEN ' ($FN)' ELSE '' END || ': C:' || path AS message,
 '/c' || replace(left(path, length(path) - length('f' || key)), '\\', '/') AS file_path, 'f' || key AS file_name FROM u WHERE NOT (kind LIKE '%FN)' AND key % 6 = 0)""")
def mft_events(spark, sf):
    captures = _entries(spark, sf).select("upload_id").distinct().select("upload_id", F.lit("s0").alias("site_id"), F.lit("h").alias("host_name"))
    out = files.mft_events(_entries(spark, sf), captures)
    return out.select(
        iso_ms(F.col("datetime")).alias("at"), "timestamp_desc", "message", F.col("attrs")["file_path"].alias("file_path"),
        F.col("attrs")["file_name"].alias("file_name"),
    )


@query("c09_listing_without_mft", f"{WITH_FILES} SELECT id FROM ft WHERE upload_id IN ('u0', 'u1') AND event_type = 'file_timeline'".replace("upload_id IN ('u0', 'u1')", "upload_id NOT IN (SELECT upload_id FROM ft WHERE l_suppkey % 5 > 1)"))
def listing_without_mft(spark, sf):
    df = file_timeline(spark, sf)
    listing = df.where(F.col("event_type") == "file_timeline")
    return files.listing_where_no_mft(listing, df.where(F.col("l_suppkey") % 5 > 1)).select("id")


@query("g18_timestomp", f"""{WITH_FILES} SELECT upload_id, file_path, file_name, strftime(si, '{ISO}') AS si_created, strftime(fn, '{ISO}') AS fn_created FROM (SELECT upload_id, file_path, file_name,
 max(datetime) FILTER (timestamp_desc = 'File Created') AS si, max(datetime) FILTER (timestamp_desc = 'File Created ($FN)') AS fn FROM ft GROUP BY 1, 2, 3) WHERE fn > si""")
def timestomp(spark, sf):
    df = file_timeline(spark, sf).select("*", F.col("attrs")["file_path"].alias("file_path"), F.col("attrs")["file_name"].alias("file_name"))
    out = files.timestomp_candidates(df, ["upload_id", "file_path", "file_name"])
    return out.select("upload_id", "file_path", "file_name", iso_ms(F.col("si_created")).alias("si_created"), iso_ms(F.col("fn_created")).alias("fn_created"))


# ---------------------------------------------------------- Windows event text

_IDS = [4624, 4625, 4634, 4648, 4672, 4688, 4720, 4732, 5156, 5152, 4104, 400, 10, 11, 106, 999, 21, 40, 1149, 7045, 7040, 1]
_CHANNELS = ["Security", "Windows PowerShell", "DhcpAdmin", "Microsoft-Windows-TaskScheduler/Operational",
             "Microsoft-Windows-TerminalServices-Gateway/Operational", "System", "DNS Server", "SMBServer", "Windows Defender", "Application"]


def _pick(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), i)


@query("c10_category", f"""{WITH_EVENTS}, x AS (SELECT id, {_IDS}[id % {len(_IDS)} + 1] AS eid, {_CHANNELS}[id // {len(_IDS)} % {len(_CHANNELS)} + 1] AS ch FROM ev)
SELECT id, CASE WHEN ch = 'Security' AND eid IN (4624, 4625, 4634, 4648, 4672) THEN 'windows_logon' WHEN ch = 'Security' AND eid = 4688 THEN 'windows_process'
 WHEN ch = 'Security' AND eid IN (4720, 4732) THEN 'windows_account' WHEN ch = 'Security' AND eid IN (5156, 5152) THEN 'windows_firewall'
 WHEN ch LIKE '%Task%' THEN 'windows_task' WHEN ch LIKE '%TerminalServices%' THEN 'windows_rdp' WHEN ch LIKE '%PowerShell%' THEN 'windows_powershell'
 WHEN ch LIKE '%DNS%' THEN 'windows_dns' WHEN ch LIKE '%SMB%' THEN 'windows_smb' WHEN ch LIKE '%Defender%' THEN 'windows_defender' WHEN ch LIKE '%Dhcp%' THEN 'windows_dhcp'
 WHEN ch = 'System' AND eid IN (7045, 7040) THEN 'windows_service' ELSE 'windows_event' END AS category FROM x""")
def category(spark, sf):
    df = raw_events(spark, sf)
    i = F.col("id")
    eid = _pick(_IDS, (i % len(_IDS)).cast("int"))
    channel = _pick(_CHANNELS, (F.call_function("div", i, F.lit(len(_IDS)).cast("long")) % len(_CHANNELS)).cast("int"))
    return df.select("id", windows.category(eid, channel).alias("category"))


@query("c11_message", f"""{WITH_EVENTS}, x AS (SELECT id, k, user_id, {_IDS}[id % {len(_IDS)} + 1] AS eid, {_CHANNELS}[id // {len(_IDS)} % {len(_CHANNELS)} + 1] AS ch,
 CASE WHEN k % 4 = 0 THEN 'Unknown' ELSE 'user' || user_id END AS u, CASE WHEN k % 4 = 0 THEN '' ELSE 'user' || user_id END AS u0, '10.0.0.' || k AS a FROM ev)
SELECT id, CASE WHEN ch = 'Security' AND eid = 4624 THEN 'Logon: ' || u || ' (Type ' || CASE WHEN k % 5 = 0 THEN '?' ELSE CAST(k % 5 AS VARCHAR) END || ')'
 WHEN ch = 'Security' AND eid = 4625 THEN 'Failed logon: ' || u WHEN ch = 'Security' AND eid = 4634 THEN 'Logoff: ' || u
 WHEN ch = 'Security' AND eid = 4648 THEN 'Explicit credentials: Unknown → srv' WHEN ch = 'Security' AND eid = 4672 THEN 'Special privileges assigned: Unknown'
 WHEN ch = 'Security' AND eid = 4688 THEN 'Process created: p' || k || ' by Unknown' WHEN ch = 'Security' AND eid = 4720 THEN 'User account created: ' || u0
 WHEN ch = 'Security' AND eid = 4732 THEN 'User  added to group ' || u0 WHEN ch = 'Security' AND eid = 5156 THEN 'WFP allowed: Unknown ' || a || ':' || k || ' → 1.1.1.1:443'
 WHEN ch = 'Security' AND eid = 5152 THEN 'WFP dropped packet: Unknown ' || a || ' → 1.1.1.1'
 WHEN ch LIKE '%PowerShell%' AND eid = 4104 THEN 'PowerShell script: ' || repeat('x', 100) || '...' WHEN ch LIKE '%PowerShell%' AND eid = 400 THEN 'PowerShell engine started'
 WHEN ch LIKE 'Dhcp%' THEN CASE WHEN eid = 10 AND k % 2 = 0 THEN 'DHCP: Lease assigned 9.9.9.9 to h' || k WHEN eid = 10 THEN 'DHCP: Lease assigned 9.9.9.9' WHEN eid = 11 THEN 'DHCP: Lease renewed 9.9.9.9' ELSE 'DHCP: Event ' || eid END
 WHEN ch LIKE '%Task%' THEN CASE WHEN eid = 106 THEN 'Scheduled task registered: t' ELSE 'Task Scheduler event ' || eid || ': t' END
 WHEN ch LIKE '%TerminalServices%' THEN CASE eid WHEN 21 THEN 'RDP session logon: ' WHEN 1149 THEN 'RDP authentication succeeded: ' WHEN 40 THEN 'RDP session 7 disconnected (reason code in event)' ELSE 'Terminal Services event ' || eid END
   || CASE WHEN eid IN (21, 1149) THEN CASE WHEN k % 3 = 0 THEN 'ts (local console)' WHEN k % 3 = 1 THEN 'ts from ' || a ELSE 'ts' END ELSE '' END
 WHEN ch = 'System' AND eid = 7045 THEN 'Service installed: svc' WHEN ch = 'System' AND eid = 7040 THEN 'Service start type changed: p1'
 ELSE 'Windows Event ' || eid || ' from ' || ch END AS message FROM x""")
def event_message(spark, sf):
    df = raw_events(spark, sf)
    i, k = F.col("id"), F.col("k")
    eid = _pick(_IDS, (i % len(_IDS)).cast("int"))
    channel = _pick(_CHANNELS, (F.call_function("div", i, F.lit(len(_IDS)).cast("long")) % len(_CHANNELS)).cast("int"))
    address = F.concat(F.lit("10.0.0."), k.cast("string"))
    payload = attribute_map({
        "TargetUserName": F.when(k % 4 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))),
        "LogonType": F.when(k % 5 != 0, k % 5), "TargetServerName": F.lit("srv"),
        "NewProcessName": F.concat(F.lit("p"), k.cast("string")), "SourceAddress": address, "SourcePort": k,
        "DestAddress": F.lit("1.1.1.1"), "DestPort": F.lit("443"), "ScriptBlockText": F.lit("x" * 300),
        "ipAddress": F.lit("9.9.9.9"), "hostname": F.when(k % 2 == 0, F.concat(F.lit("h"), k.cast("string"))),
        "Name": F.lit("t"), "UserName": F.lit("ts"), "Session": F.lit("7"), "ServiceName": F.lit("svc"), "param1": F.lit("p1"),
        "Address": F.when(k % 3 == 0, F.lit("LOCAL")).when(k % 3 == 1, address),
    })
    df = df.withColumn("_p", payload)
    return df.select("id", windows.message(eid, channel, windows.payload_getter(F.col("_p"))).alias("message"))


@query("c12_section_events", f"""{WITH_EVENTS} SELECT id AS seq, strftime(date_trunc('millisecond', ts), '{ISO}') AS at, 'Windows Event Log Entry' AS timestamp_desc,
 CASE WHEN kind = 'view' THEN 'Logon: user' || user_id || ' (Type ?)' ELSE 'Windows Event 9 from Application' END AS message,
 CASE WHEN kind = 'view' THEN 'windows_logon' ELSE 'windows_event' END AS event_type, CASE WHEN kind = 'view' THEN 'Security' ELSE 'Application' END AS channel,
 CAST(k AS VARCHAR) AS record_number FROM ev WHERE k % 3 > 0""")
def section_events(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k, view = F.col("k"), F.col("kind") == "view"
    info = F.to_json(F.struct(
        F.when(k % 3 == 1, F.lit("SystemAPI")).alias("extractor"), F.when(~view, F.lit("Application")).alias("eventLogName"),
        k.cast("string").alias("eventLogRecordId"),
    ))
    recs = as_records(df, {
        "extractor": F.when(k % 3 == 2, F.lit("SystemAPI")).otherwise(F.lit("Other")), "time": F.unix_millis("ts"),
        "eventID": F.when(view, F.lit(4624)).otherwise(F.lit(9)), "sourceInfo": info,
        "payload": F.to_json(F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("TargetUserName"))),
    })
    out = windows.section_events(recs)
    return shown(out, F.col("attrs")["channel"].alias("channel"), F.col("attrs")["record_number"].alias("record_number"))


@query("c13_log_records", f"""{WITH_EVENTS} SELECT id AS seq, strftime(date_trunc('millisecond', ts), '{ISO}') AS at, 'Failed logon: e' || k AS message, 'e' || k AS target, 'u' || user_id AS extra FROM ev""")
def log_records(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k = F.col("k").cast("string")
    data = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("e"), k).alias("TargetUserName"), F.lit("x").alias("xmlns")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("TargetUserName").alias("@Name"), F.concat(F.lit("e"), k).alias("#text"))).alias("Data")))
    )
    user = F.to_json(F.struct(F.struct(F.lit("lost").alias("TargetUserName"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Extra")).alias("Inner")))
    recs = as_records(df, {
        "file_time": F.unix_micros("ts") * 10 + F.lit(116444736000000000), "event_id": F.lit(4625), "channel": F.lit("Security"),
        "event_data": data, "user_data": user, "record_id": F.col("id"),
    })
    out = windows.evtx_events(recs)
    return out.select("seq", iso_ms(F.col("datetime")).alias("at"), "message", F.col("attrs")["TargetUserName"].alias("target"), F.col("attrs")["Extra"].alias("extra"))


# --------------------------------------------------------- classes and builders

@query("c17_connections", f"""{WITH_EVENTS} SELECT id AS seq, '2024-02-01T00:00:00.000Z' AS at, 'Collection Time (Connection Active)' AS timestamp_desc,
 CASE WHEN k % 3 = 0 THEN 'Listening: TCP 0.0.0.0:' || k WHEN k % 3 = 1 THEN 'UDP Listener: 0.0.0.0:' || k ELSE 'Connected: 0.0.0.0:' || k || ' -> 9.9.9.9:443' END
 || CASE WHEN user_id > 0 THEN ' (PID:' || user_id || ' svc)' ELSE '' END AS message, 'active_connection' AS event_type,
 CASE WHEN k % 3 = 0 THEN 'listeningPort' WHEN k % 3 = 1 THEN 'udpListener' ELSE 'establishedConnection' END AS kind FROM ev""")
def connections(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k = F.col("k")
    recs = as_records(df, {
        "protocol": F.when(k % 3 == 1, F.lit("UDP")).otherwise(F.lit("TCP")), "local_address": F.lit("0.0.0.0"), "local_port": k,
        "remote_address": F.lit("9.9.9.9"), "remote_port": F.lit(443), "state": F.when(k % 3 == 0, F.lit("LISTEN")).otherwise(F.lit("ESTABLISHED")),
        "pid": F.col("user_id"), "process_name": F.lit("svc"),
    })
    return shown(live.connections(recs), F.col("attrs")["connection_type"].alias("kind"))


@query("c21_accounts", """SELECT c_custkey AS seq, 'User account: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' [DISABLED]' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' [LOCKED]' ELSE '' END
 || CASE WHEN c_mktsegment = 'BUILDING' THEN ' [ADMIN]' ELSE '' END AS message, CASE WHEN c_custkey % 5 = 0 THEN 'locked' WHEN c_custkey % 3 = 0 THEN 'disabled' ELSE 'active' END AS status FROM customer""")
def accounts(spark, sf):
    key = F.col("c_custkey")
    group = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("ADMINISTRATORS")).otherwise(F.lit("Users"))
    recs = as_records(read(spark, sf, "customer").withColumn("seq", key), {
        "username": F.col("c_name"), "is_disabled": key % 3 == 0, "is_locked": key % 5 == 0, "groups": F.to_json(F.array(F.lit("Everyone"), group)),
    })
    return live.user_accounts(recs).select("seq", "message", F.col("attrs")["account_status"].alias("status"))


@query("c25_persistence_files", f"""WITH r AS (SELECT o_orderkey AS seq, o_orderdate AS m, ['rc.local', 'users/bob/.bashrc', 'xdg/autostart/a.desktop', 'units/b.service', 'other'][o_orderkey % 5 + 1] AS rel FROM orders),
u AS (SELECT seq, rel, unnest([m, TIMESTAMP '2024-02-01 00:00:00']) AS w, unnest(['File Modified', 'Collection Time (Persistence Configured)']) AS timestamp_desc FROM r)
SELECT seq, strftime(w, '{ISO}') AS at, timestamp_desc, 'Persistence (' || CASE WHEN rel = 'rc.local' THEN 'system_init' WHEN rel LIKE '%.bashrc' THEN 'shell_init' WHEN rel LIKE '%autostart%' THEN 'desktop_autostart' WHEN rel LIKE '%.service' THEN 'systemd' ELSE 'persistence' END
 || '): ' || CASE WHEN rel LIKE 'users/%' THEN '/home/bob/.bashrc' ELSE '/etc/' || rel END AS message, 'startup_item' AS event_type FROM u""")
def persistence_files(spark, sf):
    key = F.col("o_orderkey")
    rel = _pick(["rc.local", "users/bob/.bashrc", "xdg/autostart/a.desktop", "units/b.service", "other"], (key % 5).cast("int"))
    base = read(spark, sf, "orders").withColumn("seq", key)
    recs = as_records(base, {"x": F.lit("y")}, keep=(rel.alias("rel"), F.col("o_orderdate").cast("timestamp").alias("mtime"), F.lit(10).alias("size")))
    return shown(linux.persistence(recs))


@query("c26_shell_history", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '2024-01-01T00:00:00.000Z' ELSE strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS at,
 role || ' --x ' || turn AS command FROM conversations""")
def shell_history(spark, sf):
    turn = F.col("turn").cast("string")
    cmd = F.concat("role", F.lit(" --x "), turn)
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), cmd)).otherwise(
        F.concat(F.lit(": "), (F.col("turn") + 1700000000).cast("string"), F.lit(":0;"), cmd)
    )
    base = read(spark, sf, "conversations").withColumn("seq", F.col("conv_id"))
    lines = as_records(base, {"x": F.lit("y")}, keep=(
        line.alias("line"), (F.col("turn") + 1).cast("long").alias("line_no"), F.lit("bob/.zsh_history").alias("rel"),
        F.lit("bob/.zsh_history").alias("file"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"),
    ))
    out = linux.shell_history(lines)
    return out.select(
        F.col("seq").alias("conv_id"), (F.col("attrs")["line"].cast("long") - 1).alias("turn"), iso_ms(F.col("datetime")).alias("at"),
        F.col("attrs")["command"].alias("command"),
    )


@query("c26_fish_history", """SELECT conv_id, turn, role || ' ' || turn AS command, CASE WHEN turn % 2 = 0 THEN '2024-01-01T00:00:00.000Z' ELSE strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS at FROM conversations""")
def fish_history(spark, sf):
    turn = F.col("turn").cast("string")
    pair = F.array(
        F.struct((F.col("turn") * 2 + 1).cast("long").alias("line_no"), F.concat(F.lit("- cmd: "), "role", F.lit(" "), turn).alias("line")),
        F.struct((F.col("turn") * 2 + 2).cast("long").alias("line_no"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("  when: "), (F.col("turn") + 1700000000).cast("string"))).otherwise(F.lit("  paths:")).alias("line")),
    )
    base = read(spark, sf, "conversations").withColumn("seq", F.col("conv_id")).withColumn("p", F.explode(pair))
    lines = as_records(base, {"x": F.lit("y")}, upload=F.concat(F.lit("u"), F.col("conv_id").cast("string")), keep=(
        F.col("p.line").alias("line"), F.col("p.line_no").alias("line_no"), F.lit("bob/fish_history").alias("rel"),
        F.lit("fish_history").alias("file"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"),
    ))
    out = linux.shell_history(lines)
    return out.select(
        F.col("seq").alias("conv_id"), F.call_function("div", F.col("attrs")["line"].cast("long"), F.lit(2).cast("long")).alias("turn"),
        F.col("attrs")["command"].alias("command"), iso_ms(F.col("datetime")).alias("at"),
    )


@query("c27_blocks", """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations""")
def line_blocks(spark, sf):
    lines = read(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("line_no"), "role")
    return blocks(lines, ["conv_id"], F.col("role") == "user", chunk=3).select("conv_id", "turn", "block")


@query("c27_carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""")
def carry(spark, sf):
    """One group holds every row here, so only the chunks spread the work."""
    df = read(spark, sf, "events").select("event_id", "event_type", F.lit(1).alias("g"))
    out = carry_forward(df, ["g"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "last_signup", chunk=500)
    return out.select("event_id", "last_signup")


@query("c27_background_items", """WITH b AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT conv_id, turn AS seq, 'BTM persistence: item ' || turn || ' (agent)' AS message FROM b""")
def background_items(spark, sf):
    turn = F.col("turn").cast("string")
    rows = F.when(F.col("role") == "user", F.array(
        F.concat(F.lit(" #"), turn, F.lit(":")), F.lit("   Name: (null)"), F.concat(F.lit("   Identifier: item "), turn), F.lit("   Type: agent"),
    )).otherwise(F.array(F.lit("   Unknown: x"), F.lit("noise")))
    base = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(rows).alias("pos", "line")).withColumn("seq", F.lit(0))
    lines = as_records(base, {"x": F.lit("y")}, upload=F.col("conv_id").cast("string"), keep=(
        F.lit("btm.txt").alias("file"), (F.col("turn") * 10 + F.col("pos")).cast("long").alias("line_no"), "line",
    )).drop("rec")
    out = macos.background_items(lines)
    return out.select(F.col("upload_id").cast("long").alias("conv_id"), F.call_function("div", F.col("seq"), F.lit(10).cast("long")).alias("seq"), "message")


@query("c29_visits", f"""SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '{ISO}') AS at, CASE WHEN p_partkey % 3 = 0 THEN 'http://x/' || p_partkey ELSE p_name || ' (http://x/' || p_partkey || ')' END AS message FROM lineitem JOIN part ON l_partkey = p_partkey""")
def visits(spark, sf):
    db = F.lit("p/History")
    li = read(spark, sf, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    v = as_records(li, {
        "url": F.col("l_partkey"), "visit_time": F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.lit(11644473600000000),
        "part": F.col("l_partkey"),
    }, keep=(db.alias("db_path"),))
    part = read(spark, sf, "part").withColumn("seq", F.col("p_partkey"))
    key = F.col("p_partkey")
    u = as_records(part, {
        "id": key, "url": F.concat(F.lit("http://x/"), key.cast("string")), "title": F.when(key % 3 != 0, F.col("p_name")),
    }, keep=(db.alias("db_path"),))
    joined = browsers.join_visits(v.withColumn("rec", F.map_filter("rec", lambda k, _: k != "part").alias("rec")), u.withColumn("rec", F.col("rec")), "url", "id")
    # The visit's own `url` is the key; the page address comes from the URL row.
    joined = joined.withColumn("rec", F.map_concat(F.map_filter("rec", lambda k, _: k != "url"), F.create_map(
        F.lit("url"), F.concat(F.lit("http://x/"), F.col("rec")["url"]), F.lit("browser"), F.lit("chrome"), F.lit("key"), F.col("rec")["url"],
    )))
    out = browsers.chromium_visits(joined)
    return out.select(
        F.call_function("div", F.col("seq"), F.lit(10).cast("long")).alias("l_orderkey"), (F.col("seq") % 10).cast("int").alias("l_linenumber"),
        F.regexp_extract("message", r"http://x/(\d+)", 1).cast("long").alias("l_partkey"), iso_ms(F.col("datetime")).alias("at"), "message",
    )


@query("c30_usage_streams", f"""{WITH_EVENTS} SELECT id AS seq, strftime(date_trunc('second', ts), '{ISO}') AS at, CASE k % 4 WHEN 0 THEN 'App Used' WHEN 1 THEN 'Device Lock State' WHEN 2 THEN 'Battery Level' ELSE 'Display Backlit State' END AS timestamp_desc,
 CASE k % 4 WHEN 0 THEN 'App used: app' || user_id WHEN 1 THEN 'Device ' || CASE WHEN user_id % 2 = 1 THEN 'locked' ELSE 'unlocked' END WHEN 2 THEN 'Battery 50%' ELSE 'Display ' || CASE WHEN user_id % 2 = 1 THEN 'on' ELSE 'off' END END AS message,
 CASE k % 4 WHEN 0 THEN 'application_usage' WHEN 1 THEN CASE WHEN user_id % 2 = 1 THEN 'device_locked' ELSE 'device_unlocked' END WHEN 2 THEN 'battery_level' ELSE CASE WHEN user_id % 2 = 1 THEN 'display_on' ELSE 'display_off' END END AS event_type FROM ev WHERE k % 10 <> 9""")
def usage_streams(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k = F.col("k")
    stream = _pick(["/app/usage", "/device/isLocked", "/battery/percentage", "/display/isBacklit"], (k % 4).cast("int"))
    at = F.unix_seconds("ts").cast("double") - 978307200
    recs = as_records(df, {
        "ZSTREAMNAME": F.when(k % 10 == 9, F.lit("/other")).otherwise(stream), "ZVALUESTRING": F.concat(F.lit("app"), F.col("user_id").cast("string")),
        "ZVALUEINTEGER": F.col("user_id") % 2, "ZVALUEDOUBLE": F.lit(0.5), "ZSTARTDATE": F.when(k % 2 == 0, at), "ZCREATIONDATE": at,
    })
    return shown(macos.usage_streams(recs))


@query("c32_usage_names", f"""SELECT o_orderkey AS seq, 'Network usage: ' || coalesce(CASE WHEN o_custkey <> 7 THEN c_name END, 'App-' || o_custkey) || ' (user: User-7, recv: ' || (o_orderkey % 1000) || 'B, sent: 2.0KB)' AS message FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0""")
def usage_names(spark, sf):
    ids = read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.lit("u0").alias("upload_id"), F.col("c_custkey").alias("id_index"), F.col("c_name").alias("name"))
    recs = as_records(read(spark, sf, "orders").withColumn("seq", F.col("o_orderkey")), {
        "TimeStamp": F.lit("45000.5"), "AppId": F.col("o_custkey"), "UserId": F.lit(7), "BytesRecvd": F.col("o_orderkey") % 1000, "BytesSent": F.lit(2048),
    })
    no_users = ids.where(F.col("id_index") != 7)
    return records.usage_network(records.name_usage_ids(recs, no_users)).select("seq", "message")


@query("c33_activity", f"""{WITH_EVENTS} SELECT id AS seq, strftime(date_trunc('second', ts), '{ISO}') AS at, CASE WHEN k % 3 = 0 THEN 'User Engagement Started' WHEN k % 3 = 1 THEN 'File/Document Opened' ELSE 'Windows Timeline Activity' END AS timestamp_desc,
 CASE WHEN k % 3 = 0 THEN 'User Engaged: app' || CASE WHEN user_id = 0 THEN '' WHEN user_id * 60 >= 3600 THEN printf(' (%.1fh)', round_even(user_id / 60.0, 1)) ELSE printf(' (%.1fm)', user_id::DOUBLE) END WHEN k % 3 = 1 THEN 'Timeline: Type-5 - app' ELSE 'Timeline: Type-99 - app' END AS message,
 CASE WHEN k % 3 = 0 THEN 'timeline_engaged' ELSE 'timeline_activity' END AS event_type FROM ev""")
def activity(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k, s = F.col("k"), F.unix_seconds("ts")
    recs = as_records(df, {
        "AppId": F.lit('[{"application":"app"}]'), "ActivityType": F.when(k % 3 == 0, F.lit(6)).when(k % 3 == 1, F.lit(5)).otherwise(F.lit(99)),
        "LastModifiedTime": F.when(k % 2 == 0, s).otherwise(s * 10000000 + F.lit(116444736000000000)), "StartTime": s, "EndTime": s + F.col("user_id") * 60,
    })
    return shown(records.activities(recs))


@query("c37_suspicious_commands", """SELECT doc_id, contains(lower(text), 'bypass') OR contains(lower(text), 'certutil') OR contains(lower(text), 'add-type') OR contains(lower(text), '-nop') OR contains(lower(text), 'iex ') OR contains(lower(text), 'iex(')
 OR contains(lower(text), 'downloadstring') OR contains(lower(text), 'downloadfile') OR contains(lower(text), 'net.webclient') OR contains(lower(text), 'invoke-webrequest') OR contains(lower(text), 'invoke-expression') OR contains(lower(text), 'start-bitstransfer')
 OR contains(lower(text), '-encodedcommand') OR contains(lower(text), '-w hidden') OR contains(lower(text), 'frombase64string') OR contains(lower(text), 'invoke-mimikatz') OR contains(lower(text), 'invoke-shellcode') OR contains(lower(text), 'invoke-bloodhound')
 OR contains(lower(text), 'new-object system.net') OR contains(lower(text), 'reflection.assembly') OR contains(lower(text), 'compilerparameters') AS odd
FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN text || ' IEX(' WHEN 1 THEN text || ' -NoProfile' ELSE text END AS text FROM documents)""")
def suspicious_commands(spark, sf):
    tail = F.when(F.col("doc_id") % 9 == 0, F.lit(" IEX(")).when(F.col("doc_id") % 9 == 1, F.lit(" -NoProfile")).otherwise(F.lit(""))
    return read(spark, sf, "documents").select("doc_id", records.suspicious_command(F.concat("text", tail)).alias("odd"))


@query("c37_winlogon", """SELECT c_custkey AS seq, 'Winlogon Shell: ' || CASE WHEN c_custkey % 4 = 0 THEN ' Explorer.EXE ' ELSE c_name END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' [SUSPICIOUS]' END AS message, c_custkey % 4 > 0 AS is_suspicious FROM customer""")
def winlogon(spark, sf):
    key = F.col("c_custkey")
    recs = as_records(read(spark, sf, "customer").withColumn("seq", key), {
        "hive": F.lit("SOFTWARE"), "key_path": F.lit(r"Microsoft\Windows NT\CurrentVersion\Winlogon"), "key_time": F.lit("2024-01-01T00:00:00Z"),
        "value_name": F.lit("shell"), "value_string": F.when(key % 4 == 0, F.lit(" Explorer.EXE ")).otherwise(F.col("c_name")),
    })
    return registry.winlogon(recs).select("seq", "message", "is_suspicious")


@query("c38_keyword_occurrences", """SELECT doc_id, 'ing' AS pattern, CAST(count(*) AS BIGINT) AS n, CAST(min(o) AS BIGINT) AS first_at, CAST(max(o) AS BIGINT) AS last_at FROM (
 SELECT doc_id, p, sum(length(piece) + 3) OVER (PARTITION BY doc_id ORDER BY p) - 3 AS o, p = count(*) OVER (PARTITION BY doc_id) AS tail FROM (
  SELECT doc_id, unnest(string_split(text, 'ing')) AS piece, generate_subscripts(string_split(text, 'ing'), 1) AS p FROM documents)) WHERE NOT tail GROUP BY doc_id""")
def keyword_occurrences(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    hits = records.occurrences(docs, F.col("text"), ["ing", "PowerShell"])
    return hits.groupBy("doc_id", "pattern").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").cast("long").alias("first_at"), F.max("offset").cast("long").alias("last_at")
    )


# Hits of one pattern at different places of a file are different events.
@query("c38_repository_events", """SELECT 'u' || (doc_id % 5) AS upload_id, 'WMI: ' || p || ' found in OBJECTS.DATA' AS message, CAST(o AS VARCHAR) AS at, min(doc_id) AS seq FROM (
 SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cmd.exe' ELSE 'mshta' END AS p, length(text) + 1 + unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 8] ELSE [0] END) AS o FROM documents) GROUP BY doc_id % 5, p, o""")
def repository_events(spark, sf):
    docs = read(spark, sf, "documents").withColumn("seq", F.col("doc_id"))
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" cmd.exe cmd.exe")).otherwise(F.lit(" mshta")))
    recs = as_records(docs, {"text": body, "file": F.lit("OBJECTS.DATA")}, upload=F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")))
    return emit(records.repository_keywords(recs)).select("upload_id", "message", F.col("attrs")["offset"].alias("at"), "seq")


@query("c43_cloud_and_mail", f"""{WITH_EVENTS}, e AS (SELECT *, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS w FROM ev)
SELECT id AS seq, w AS at, CASE k % 4 WHEN 0 THEN 'Entra ID Sign-In Event' WHEN 1 THEN 'Entra ID Audit Event' ELSE 'MDO Event Time' END AS timestamp_desc,
 CASE WHEN k % 4 < 2 THEN 'Entra: u' || user_id || ' ->  from 9.9.9.9 (' || id || ')' WHEN k % 4 = 2 THEN 'MDO URL Click: http://x/' || id ELSE 'MDO Email: u' || user_id || ' -> : ' || id END AS message,
 CASE k % 4 WHEN 0 THEN 'entra_signin' WHEN 1 THEN 'entra_audit' WHEN 2 THEN 'mdo_url_click' ELSE 'mdo_email_event' END AS event_type,
 CASE WHEN k % 4 < 2 THEN CAST(id AS VARCHAR) END AS resource, CASE WHEN k % 4 >= 2 THEN CAST(id AS VARCHAR) END AS mail_id, CASE WHEN k % 4 = 2 THEN 'http://x/' || id END AS url,
 CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 3 END AS n_attrs FROM e""")
def cloud_and_mail(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    k, at, user = F.col("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    cloud = as_records(df.where(k % 4 < 2), {
        "createdDateTime": F.when(k % 4 == 0, at), "activityDateTime": at, "userPrincipalName": user, "ipAddress": F.lit("9.9.9.9"),
        "activityDisplayName": F.when(k % 4 == 1, F.lit("Add member")), "resourceDisplayName": F.col("id"),
    })
    mail = as_records(df.where(k % 4 >= 2), {
        "ClickTime": F.when(k % 4 == 2, at), "Timestamp": at, "NetworkMessageId": F.col("id"), "SenderAddress": user, "Subject": F.col("id"),
        "Url": F.concat(F.lit("http://x/"), F.col("id").cast("string")),
    })
    a = F.col("attrs")
    return shown(run_all({"cloud": cloud, "mail": mail}), a["resourceDisplayName"].alias("resource"), a["networkMessageId"].alias("mail_id"), a["url"].alias("url"),
                 F.size(a).alias("n_attrs"))


@query("k01_run_all", f"""{WITH_EVENTS}, first AS (SELECT user_id, min(id) AS seq FROM ev GROUP BY user_id)
SELECT seq, '{COLLECTED}' AS at, 'Collection Time (DNS Cache Snapshot)' AS timestamp_desc, 'DNS Cache: ' || user_id || ' -> 1.1.1.1' AS message, 'dns_cache_entry' AS event_type, CAST(user_id AS VARCHAR) AS hostname, NULL AS destination FROM first
UNION ALL SELECT seq, '{COLLECTED}', 'Collection Time (Routing Table Snapshot)', 'Route: ' || user_id || ' (direct)', 'routing_entry', NULL, CAST(user_id AS VARCHAR) FROM first""")
def run_registered(spark, sf):
    df = raw_events(spark, sf).withColumn("seq", F.col("id"))
    user = F.col("user_id").cast("string")
    out = run_all({
        "live.dns_cache": as_records(df, {"name": user, "data": F.lit("1.1.1.1")}),
        "live.routing_table": as_records(df, {"destination": user}),
    })
    return shown(out, F.col("attrs")["hostname"].alias("hostname"), F.col("attrs")["destination"].alias("destination"))
