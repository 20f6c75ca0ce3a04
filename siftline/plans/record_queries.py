"""Readers and the builders of live state, sections, text tables and registries.

Records are derived from whole test tables. For readers, a table is first written as
the files that a collector would leave, in the shared folder, and then read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.times import iso_ms
from siftline.operators import files, linux, live, macos, records, registry, sections
from siftline.operators.build import BUILDERS
from siftline.operators.filters import by_artifact
from siftline.plans.builder_queries import COLLECTED, as_records, shown
from siftline.plans.mapping import WITH_EVENTS, raw_events, read, timeline
from siftline.plans.registry import query
from siftline.session import shared_folder
from siftline.sources import records as src
from siftline.sources import timeline as tl

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"
NO_RECORD = "cast(map() as map<string,string>)"
CUSTOMER, SUPPLIER, PART = "customer", "supplier", "part"
#: Files of one record each that a task writes.
FILES_A_TASK = 250


def table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return read(spark, sf, name).withColumn("seq", F.col(key))


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def as_lines(df: DataFrame, line: Column, **columns) -> DataFrame:
    """Line frame with one capture key; `seq` is the line's number too."""
    out = as_records(df.withColumns({"line_no": F.col("seq").cast("int"), "line": line}), {}, keep=("line_no", "line"))
    fixed = {"file": F.lit("f.txt"), "rel": F.lit("f.txt"), "size": F.lit(7), "mtime": F.lit("2024-01-15 10:00:00").cast("timestamp")}
    return out.withColumns(fixed | {k: F.lit(v) for k, v in columns.items()}).withColumn("rec", F.expr(NO_RECORD))


def _row(desc: str, message: str, kind: str, at: str = f"'{COLLECTED}'", key: str = "k") -> str:
    return f"SELECT {key} AS seq, {at} AS at, '{desc}' AS timestamp_desc, {message} AS message, '{kind}' AS event_type"


# ------------------------------------------------------------------ live state

_SUPPLIER = "FROM (SELECT *, s_suppkey AS k FROM supplier)"
_CUSTOMER = "FROM (SELECT *, c_custkey AS k FROM customer)"
_PART = "FROM (SELECT *, p_partkey AS k FROM part)"


_COMMAND = "CASE WHEN k % 3 > 0 THEN ' run' || CASE WHEN k % 150 > 97 THEN repeat('x', 97) || '...' ELSE repeat('x', CAST(k % 150 AS INT)) END ELSE '' END"


@query("c16_live_processes", f"""{_row('Collection Time (Process Running)', f"'Running: ' || c_name || ' (PID:' || k || ')' || {_COMMAND}", 'running_process')}, 'm1; m2' AS modules, CASE WHEN k % 2 = 0 THEN 'DOM' END AS domain {_CUSTOMER}""")
def live_processes(spark, sf):
    k = F.col("c_custkey")
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {
        "name": F.col("c_name"), "pid": text(k), "command_line": F.when(k % 3 > 0, F.concat(F.lit("run"), F.repeat(F.lit("x"), (k % 150).cast("int")))),
        "modules": F.lit('["m1","m2"]'), "user": F.when(k % 2 == 0, F.lit("DOM\\u")).otherwise(F.lit("u")),
    })
    a = F.col("attrs")
    return shown(live.processes(recs), a["loaded_modules"].alias("modules"), a["user_domain"].alias("domain"))


@query("c19_arp_and_routes", f"""{_row('Collection Time (ARP Cache Snapshot)', "'ARP Cache: 10.0.0.' || k || ' -> ' || s_name", 'arp_cache_entry')} {_SUPPLIER}
UNION ALL {_row('Collection Time (Routing Table Snapshot)', "'Route: 10.1.' || k || '.0' || CASE WHEN k % 2 = 0 THEN ' (direct)' ELSE ' via ' || s_name END", 'routing_entry')} {_SUPPLIER}""")
def arp_and_routes(spark, sf):
    df, k = table(spark, sf, SUPPLIER, "s_suppkey"), text("s_suppkey")
    arp = as_records(df, {"ip_address": F.concat(F.lit("10.0.0."), k), "mac_address": F.col("s_name")})
    gateway = F.when(F.col("s_suppkey") % 2 == 0, F.lit("0.0.0.0")).otherwise(F.col("s_name"))
    routes = as_records(df, {"destination": F.concat(F.lit("10.1."), k, F.lit(".0")), "gateway": gateway})
    return shown(live.arp_cache(arp)).unionByName(shown(live.routing_table(routes)))


@query("c20_logon_sessions", f"""{_row('Logon Session Start', "'Logon session: DOM' || chr(92) || c_name || CASE WHEN k % 2 = 0 THEN ' (Type: 10)' ELSE '' END", 'logon_session', "'2024-01-02T03:04:05.000Z'")}, c_mktsegment AS package {_CUSTOMER} WHERE k % 3 > 0
UNION ALL {_row('Collection Time (Logon Session Active)', "'Logon session: ' || c_name || CASE WHEN k % 2 = 0 THEN ' (Type: 10)' ELSE '' END", 'logon_session')}, c_mktsegment {_CUSTOMER} WHERE k % 3 = 0""")
def logon_sessions(spark, sf):
    k = F.col("c_custkey")
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {
        "username": F.col("c_name"), "domain": F.when(k % 3 > 0, F.lit("DOM")), "logon_type": F.when(k % 2 == 0, F.lit("10")),
        "logon_time": F.when(k % 3 > 0, F.lit("2024-01-02T03:04:05Z")), "auth_package": F.col("c_mktsegment"),
    })
    return shown(live.logon_sessions(recs), F.col("attrs")["auth_package"].alias("package"))


@query("c22_services_and_devices", f"""{_row('Collection Time (Service Configuration)', "'Service: ' || s_name || CASE WHEN k % 2 = 0 THEN '' ELSE ' (Shown)' END || ' [Running]'", 'startup_item')}, s_name AS named {_SUPPLIER}
UNION ALL {_row('Collection Time (Device Attached)', "'Device: ' || s_name || ' (acme)' || CASE WHEN k % 3 = 0 THEN ' [S/N: ' || k || ']' ELSE '' END", 'attached_device')}, s_name {_SUPPLIER}
UNION ALL {_row('Collection Time (Startup Configuration)', "'Startup item: ' || s_name || ' (run ' || k || ')'", 'startup_item')}, s_name {_SUPPLIER}""")
def services_and_devices(spark, sf):
    df, k, a = table(spark, sf, SUPPLIER, "s_suppkey"), F.col("s_suppkey"), F.col("attrs")
    name = F.col("s_name")
    found = [
        live.services(as_records(df, {"name": name, "display_name": F.when(k % 2 == 0, name).otherwise(F.lit("Shown")), "status": F.lit("Running")})),
        live.devices(as_records(df, {"name": name, "manufacturer": F.lit("acme"), "serial_number": F.when(k % 3 == 0, text(k))})),
        live.startup_items(as_records(df, {"name": name, "command": F.concat(F.lit("run "), text(k))})),
    ]
    parts = [shown(f, F.coalesce(a["service_name"], a["device_name"], a["description"]).alias("named")) for f in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -------------------------------------------------------------------- sections

_START = "'2024-01-01T00:00:00.000Z'"


@query("c15_section_processes", f"""{_row('Process Start Time', "'Running: ' || c_name || ' (PID:' || k || ') -v'", 'running_process', _START)} {_CUSTOMER} WHERE k % 3 = 0
UNION ALL {_row('Process Start Time', "'Process running: ' || c_name || ' (PID: ' || k || ') -v'", 'session_logon', _START)} {_CUSTOMER} WHERE k % 3 = 1
UNION ALL {_row('Program Execution Time', "'Program executed: ' || c_name || ' -v (User: bob)'", 'process_execution', _START)} {_CUSTOMER} WHERE k % 3 = 2""")
def section_processes(spark, sf):
    k = F.col("c_custkey")
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {
        "name": F.col("c_name"), "pid": text(k), "args": F.lit("-v"), "startTime": F.lit("1704067200000"), "userID": F.when(k % 3 == 2, F.lit("bob")),
        "extractor": F.when(k % 3 == 0, F.lit("LiveSnapshot")).when(k % 3 == 1, F.lit("SystemAPI")),
    })
    return shown(sections.processes(recs))


@query("c23_triggered_tasks", f"""{_row('Task Modified', "'Scheduled Task: ' || CASE WHEN k % 4 = 0 THEN 'Unknown Task' ELSE p_name END || ' [READY]' || CASE WHEN k % 2 = 0 THEN ' (Run as: root)' ELSE '' END", 'triggered_task', _START)}, 'a.exe -x; b.exe' AS actions {_PART}""")
def triggered_tasks(spark, sf):
    k = F.col("p_partkey")
    recs = as_records(table(spark, sf, PART, "p_partkey"), {
        "name": F.when(k % 4 > 0, F.col("p_name")), "state": F.lit("READY"), "userID": F.when(k % 2 == 0, F.lit("root")), "dateModified": F.lit("1704067200000"),
        "actions": F.lit('[{"path":"a.exe","args":"-x"},{"path":""},{"path":"b.exe"}]'),
    })
    return shown(sections.triggered_tasks(recs), F.col("attrs")["actions"].alias("actions"))


@query("c35_log_lines", f"""{_row('Log Entry', "'Log: ' || c_mktsegment || ' Event ' || CASE WHEN k % 5 = 0 THEN '0' ELSE k || '' END || CASE WHEN k % 2 = 0 THEN ' (User: bob)' ELSE '' END", 'log_line', _START)}, c_name AS payload {_CUSTOMER}""")
def log_lines(spark, sf):
    k = F.col("c_custkey")
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {
        "logName": F.col("c_mktsegment"), "eventID": F.when(k % 5 > 0, text(k)), "userID": F.when(k % 2 == 0, F.lit("bob")), "time": F.lit("1704067200000"),
        "payload": F.to_json(F.struct(F.col("c_name").alias("who"))),
    })
    return shown(sections.log_lines(recs), F.col("attrs")["who"].alias("payload"))


# ----------------------------------------------------------------- text tables

@query("c24_passwd", f"""{_row('Account Created/Modified', "'User account: user' || k || CASE WHEN k % 2 = 0 THEN ' (' || c_name || ')' ELSE '' END || CASE WHEN k < 1000 THEN ' [system]' ELSE '' END", 'account_created')}, CAST(k AS VARCHAR) AS uid, CASE WHEN k % 3 = 0 THEN '/bin/sh' ELSE '/sbin/a:b' END AS shell {_CUSTOMER}""")
def passwd(spark, sf):
    k = F.col("c_custkey")
    line = F.concat_ws(":", F.concat(F.lit("user"), text(k)), F.lit("x"), text(k), F.lit("1"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.lit("")), F.lit("/home"),
                       F.when(k % 3 == 0, F.lit("/bin/sh")).otherwise(F.lit("/sbin/a:b")))
    a = F.col("attrs")
    return shown(linux.passwd(as_lines(table(spark, sf, CUSTOMER, "c_custkey"), line)), a["uid"].alias("uid"), a["shell"].alias("shell"))


@query("c24_netstat", f"""{_row('Collection Time (Connection Active)', "CASE k % 3 WHEN 0 THEN 'Listening: tcp 0.0.0.0:' || k WHEN 1 THEN 'UDP Listener: 10.0.0.1:' || k ELSE 'Connected: 10.0.0.1:' || k || ' -> 10.9.9.9:443 [ESTABLISHED]' END", 'active_connection')}, CAST(k AS VARCHAR) AS port {_PART}""")
def netstat(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.format_string("tcp   0  0 0.0.0.0:%d   0.0.0.0:*  LISTEN", k)).when(
        k % 3 == 1, F.format_string("udp 0 0 10.0.0.1:%d 0.0.0.0:*", k)).otherwise(F.format_string("tcp 0 0 10.0.0.1:%d  10.9.9.9:443 ESTABLISHED", k))
    return shown(linux.netstat(as_lines(table(spark, sf, PART, "p_partkey"), line)), F.col("attrs")["local_port"].alias("port"))


@query("c24_packages", f"""{_row('Collection Time (Program Installed)', "'Installed Package (dpkg): pkg' || k || ' v1.' || k || ' [amd64]'", 'installed_program')} {_PART} WHERE k % 3 = 0
UNION ALL {_row('Collection Time (Program Installed)', "'Installed Package (apk): pkg' || k || ' 1.' || k", 'installed_program')} {_PART} WHERE k % 3 = 1
UNION ALL {_row('Collection Time (Program Installed)', "'Installed Package (snap): pkg' || k || ' v1.' || k", 'installed_program')} {_PART} WHERE k % 3 = 2""")
def packages(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat_ws("\t", F.concat(F.lit("pkg"), text(k)), F.concat(F.lit("1."), text(k)), F.lit("amd64"), F.lit("install ok installed"))).otherwise(
        F.format_string("pkg%d  1.%d", k, k))
    seq = F.col("seq")
    manager = F.when(seq % 3 == 0, F.lit("dpkg")).when(seq % 3 == 1, F.lit("apk")).otherwise(F.lit("snap"))
    return shown(linux.packages(as_lines(table(spark, sf, PART, "p_partkey"), line).withColumn("manager", manager)))


@query("c28_launchd", f"""{_row('Collection Time (Service Configuration)', "'launchd: com.' || s_name || ' [' || CASE WHEN k % 2 = 0 THEN 'running' ELSE 'loaded' END || ']'", 'startup_item')}, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '-' END AS pid {_SUPPLIER}""")
def launchd(spark, sf):
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", F.when(k % 2 == 0, text(k)).otherwise(F.lit("-")), F.lit("0"), F.concat(F.lit("com."), F.col("s_name")))
    return shown(macos.launchd_services(as_lines(table(spark, sf, SUPPLIER, "s_suppkey"), line)), F.col("attrs")["pid"].alias("pid"))


@query("c42_macos_netstat", f"""{_row('Collection Time (Connection Active)', "CASE k % 3 WHEN 0 THEN 'Listening: tcp4 :' || k || ' [LISTEN]' WHEN 1 THEN 'UDP Listener: 10.0.0.1:' || k ELSE 'Connected: 10.0.0.1:' || k || ' -> 10.9.9.9:443 [ESTABLISHED]' END", 'active_connection')} {_PART}""")
def macos_netstat(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.format_string("tcp4 0 0 *.%d *.* LISTEN", k)).when(k % 3 == 1, F.format_string("udp4 0 0 10.0.0.1.%d *.*", k)).otherwise(
        F.format_string("tcp4 0 0 10.0.0.1.%d 10.9.9.9.443 ESTABLISHED", k))
    return shown(macos.netstat(as_lines(table(spark, sf, PART, "p_partkey"), line)))


@query("c39_powershell_history", f"""{_row('PowerShell History (Collection Time)', "'PS> ' || CASE WHEN k % 4 = 0 THEN 'IEX (' || s_name || ')' ELSE s_name END", 'powershell_history')}, k % 4 = 0 AS odd {_SUPPLIER}""")
def powershell_history(spark, sf):
    line = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("  IEX ("), F.col("s_name"), F.lit(")"))).otherwise(F.col("s_name"))
    return shown(records.powershell_history(as_lines(table(spark, sf, SUPPLIER, "s_suppkey"), line)), F.col("is_suspicious").alias("odd"))


@query("c40_recycle_bin", f"""{_row('File Deletion Time', "'Deleted: C:' || chr(92) || s_name || ' (' || (k * 2) || '.0 KB)'", 'file_deleted', "'2024-01-01T00:00:00.000Z'")}, CAST(k * 2048 AS VARCHAR) AS size {_SUPPLIER}""")
def recycle_bin(spark, sf):
    k = F.col("s_suppkey")
    recs = as_records(table(spark, sf, SUPPLIER, "s_suppkey"), {
        "path": F.concat(F.lit("C:\\"), F.col("s_name")), "file_size": text(k * 2048), "deletion_time": F.lit("133485408000000000")})
    return shown(files.recycle_bin(recs), F.col("attrs")["file_size"].alias("size"))


@query("c40_shortcuts", f"""SELECT k AS seq, strftime(w, '{ISO}') AS at, 'LNK Target ' || d AS timestamp_desc, 'Shortcut target ' || lower(d) || ': ' || p_name AS message, 'lnk_target' AS event_type FROM (
 SELECT p_partkey AS k, p_name, unnest([TIMESTAMP '2024-01-01', CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2024-02-02' END]) AS w, unnest(['Created', 'Modified']) AS d FROM part) WHERE w IS NOT NULL""")
def shortcuts(spark, sf):
    k = F.col("p_partkey")
    recs = as_records(table(spark, sf, PART, "p_partkey"), {
        "local_base_path": F.concat(F.lit("C:\\d\\"), F.col("p_name")), "creation_time": F.lit("2024-01-01T00:00:00Z"),
        "write_time": F.when(k % 2 == 0, F.lit("2024-02-02T00:00:00Z")), "access_time": F.lit("1970-01-01T00:00:00Z")})
    return shown(files.shortcuts(recs))


@query("c31_permissions", f"""{_row('TCC Grant Modified', "'TCC grant: ' || s_name || ' -> Camera = ' || CASE WHEN k % 2 = 0 THEN 'allowed' ELSE 'denied' END || CASE WHEN k % 3 = 0 THEN ' (user bob)' ELSE '' END", 'tcc_grant', _START)} {_SUPPLIER}""")
def permissions(spark, sf):
    k = F.col("s_suppkey")
    recs = as_records(table(spark, sf, SUPPLIER, "s_suppkey"), {
        "client": F.col("s_name"), "service": F.lit("kTCCCamera"), "auth_value": F.when(k % 2 == 0, F.lit("2")).otherwise(F.lit("0")),
        "scope": F.when(k % 3 == 0, F.lit("user")).otherwise(F.lit("system")), "user": F.lit("bob"), "last_modified": F.lit("1704067200")})
    return shown(macos.permissions(recs))


@query("c36_run_keys", f"""{_row('Registry Key Modified', "'Startup item configured: ' || c_name || ' (run ' || k || ')'", 'startup_item', _START)}, c_name AS value {_CUSTOMER} WHERE k % 3 > 0""")
def run_keys(spark, sf):
    k = F.col("c_custkey")
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {
        "hive": F.lit("SOFTWARE"), "key_path": F.when(k % 3 > 0, F.lit(r"Microsoft\Windows\CurrentVersion\Run")).otherwise(F.lit(r"Microsoft\Other")),
        "key_time": F.lit("2024-01-01T00:00:00Z"), "value_name": F.col("c_name"), "value_string": F.concat(F.lit("run "), text(k))})
    return shown(registry.run_keys(recs), F.col("attrs")["registry_value"].alias("value"))


@query("c36_shell_bags", f"""SELECT min(k) AS seq, {_START} AS at, 'ShellBag Key Modified' AS timestamp_desc, 'Folder accessed (ShellBag): d' || k % 20 AS message, 'registry_shellbag' AS event_type, count(*) > 0 AS found {_CUSTOMER} GROUP BY k % 20""")
def shell_bags(spark, sf):
    """Every folder stands under several values; the deepest are 19 levels down."""
    depth = F.col("c_custkey") % 20
    path = F.concat(F.lit(registry.SHELL_BAGS), F.repeat(F.lit(r"\x"), depth.cast("int")), F.lit("\\d"), text(depth))
    recs = as_records(table(spark, sf, CUSTOMER, "c_custkey"), {"hive": F.lit("USRCLASS"), "key_path": path, "key_time": F.lit("2024-01-01T00:00:00Z"), "value_name": F.col("c_name")})
    return shown(registry.shell_bags(recs)).withColumn("found", F.lit(True))


# ---------------------------------------------------------------- files, readers

def left(df: DataFrame, value: Column, uploads: int, folder: str, key: Column, name: str) -> str:
    """The root of capture folders u0, u1, … of which `folder` holds the rows as text
    files; the capture of a row is `key` modulo their number."""
    root = shared_folder(df.sparkSession, name)
    for u in range(uploads):
        df.where(key % uploads == u).select(value.alias("value")).write.text(f"{root}/u{u}/{folder}")
    return root


def with_facts(recs: DataFrame) -> DataFrame:
    return recs.withColumns({"site_id": F.lit("s0"), "host_name": F.lit("host"), "collection_ts": F.lit("2024-02-01").cast("timestamp")})


@query("a02_line_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 5 > 0")
def line_count(spark, sf):
    k = F.col("c_custkey")
    root = left(read(spark, sf, "customer"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name")), 1, "live", k, "a02")
    return spark.range(1).select(F.lit(tl.count_lines(spark, f"{root}/*/live")).cast("long").alias("n"))


@query("a03_timeline_round_trip", f"""{WITH_EVENTS} SELECT id AS seq, strftime(date_trunc('millisecond', ts), '{ISO}') AS at, kind || ' by user' || user_id AS message, CAST(user_id AS VARCHAR) AS uid FROM ev""")
def timeline_round_trip(spark, sf):
    df = timeline(spark, sf).withColumn("attrs", F.create_map(F.lit("uid"), text("user_id"), F.lit("seq_no"), text("id"), F.lit("none"), F.lit("")))
    out = shared_folder(spark, "a03")
    tl.write_timeline(df, out)
    events, rejects = tl.read_timeline(spark, out, "s0", "u0")
    a = F.col("attrs")
    return events.select(a["seq_no"].cast("long").alias("seq"), iso_ms(F.col("datetime")).alias("at"), "message", a["uid"].alias("uid")).unionByName(
        rejects.select("seq", F.col("reason").alias("at"), F.col("line").alias("message"), F.lit(None).cast("string").alias("uid")))


@query("a04_event_table", f"""{WITH_EVENTS} SELECT 's' || user_id % 2 AS site_id, 'u' || user_id % 8 AS upload_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ev GROUP BY ALL""")
def event_table(spark, sf):
    """Saved, and one capture saved again: it replaces itself."""
    df, path = timeline(spark, sf), shared_folder(spark, "a04")
    tl.save_events(df.where("upload_id <> 'u3'").unionByName(df.where("upload_id = 'u3'").withColumn("seq", F.lit(0).cast("long"))), path)
    tl.save_events(df.where("upload_id = 'u3'"), path)
    return tl.load_events(spark, path).groupBy("site_id", "upload_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("ids"))


@query("a06_live", f"""{_row('Collection Time (DNS Cache Snapshot)', "'DNS Cache: ' || c_name || ' -> 10.0.0.1'", 'dns_cache_entry', key="CAST(k AS VARCHAR)")}, 'u' || k % 4 AS upload_id {_CUSTOMER}""".replace("AS seq", "AS ttl"))
def live_files(spark, sf):
    """Arrays of records, many files a capture, one of them read for each."""
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("10.0.0.1").alias("data"), text(k).alias("ttl")))
    one = read(spark, sf, "customer").groupBy((k % 4).alias("u"), (k % 16).alias("f")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(body)), F.lit("]")).alias("v"))
    root = left(one, F.col("v"), 4, "live", F.col("u"), "a06")
    out = live.dns_cache(with_facts(src.read_live(spark, f"{root}/*/live/*", "dns_cache")))
    return out.select(F.col("attrs")["ttl"].alias("ttl"), iso_ms(F.col("datetime")).alias("at"), "timestamp_desc", "message", "event_type", "upload_id")


@query("a08_sections", f"""SELECT 'OS Config: ' || c_name || ' = ' || k AS message, 'os_config' AS event_type, 'u' || k % 3 AS upload_id {_CUSTOMER} WHERE k % 2 = 0
UNION ALL SELECT 'Log: ' || c_name || ' Event ' || k, 'log_line', 'u' || k % 3 {_CUSTOMER} WHERE k % 2 = 1""")
def section_files(spark, sf):
    k = F.col("c_custkey")
    setting = F.struct(F.struct(F.col("c_name").alias("setting"), text(k).alias("value")).alias("osConfigSetting"))
    logged = F.struct(F.struct(F.col("c_name").alias("logName"), text(k).alias("eventID"), F.lit("1704067200000").alias("time")).alias("logLine"))
    line = F.when(k % 2 == 0, F.to_json(setting)).otherwise(F.to_json(logged))
    root = left(read(spark, sf, "customer"), line, 3, "sections", k, "a08")
    frames = {n: with_facts(f) for n, f in src.read_sections(spark, f"{root}/*/sections").items()}
    both = [BUILDERS[n](frames[n]).select("message", "event_type", "upload_id") for n in ("section.osConfigSetting", "section.logLine")]
    return both[0].unionByName(both[1])


@query("a09_dhcp", f"""SELECT '2024-01-05T10:00:00.000Z' AS at, 'DHCP: ' || CASE WHEN k % 2 = 0 THEN 'New Lease' ELSE 'Renewed Lease' END || ' - 10.0.0.' || k || ' (' || s_name || ')' AS message, 'AA:BB:CC:00:11:22' AS mac {_SUPPLIER}""")
def dhcp_files(spark, sf):
    k = F.col("s_suppkey")
    line = F.concat(F.when(k % 2 == 0, F.lit("10")).otherwise(F.lit("11")), F.lit(",2024-01-05,10:00:00,x,10.0.0."), text(k), F.lit(","), F.col("s_name"), F.lit(",AABBCC001122"))
    rows = read(spark, sf, "supplier").select(F.explode(F.array(F.lit("ID,Date,Time"), F.lit("# note"), line)).alias("v"), "s_suppkey")
    root = left(rows, F.col("v"), 2, "artifacts", k, "a09")
    out = records.dhcp(with_facts(src.read_dhcp(spark, f"{root}/*/artifacts")))
    return out.select(iso_ms(F.col("datetime")).alias("at"), "message", F.col("attrs")["mac_address"].alias("mac"))


@query("a10_mail_files", f"""SELECT 'MDO URL Click: http://x/' || k || ' [Allowed, "' || s_name || '"]' AS message, 'mdo_url_click' AS event_type, 'u0' AS upload_id {_SUPPLIER}
UNION ALL SELECT 'MDO Email: ' || s_name || ' -> : Re: ' || k, 'mdo_email_event', 'u1' {_SUPPLIER}""")
def mail_files(spark, sf):
    """Exports with different headings, every row with its own file's."""
    k, one = F.col("s_suppkey"), read(spark, sf, "supplier")
    clicks = F.concat(F.lit("2024-01-01T00:00:00Z,http://x/"), text(k), F.lit(',"Allowed, ""'), F.col("s_name"), F.lit('"""'))
    mails = F.concat(F.lit("m"), text(k), F.lit(","), F.col("s_name"), F.lit(",Re: "), text(k), F.lit(",2024-01-01T00:00:00Z"))
    root = shared_folder(spark, "a10")
    for u, (head, line) in enumerate((("ClickTime,Url,ClickAction", clicks), ("NetworkMessageId,SenderAddress,Subject,Timestamp", mails))):
        rows = one.groupBy((k % 3).alias("f")).agg(F.concat_ws("\n", F.lit(head), F.concat_ws("\n", F.collect_list(line))).alias("value"))
        rows.repartition(3, "f").select("value").write.option("lineSep", "\n\n").text(f"{root}/u{u}/artifacts")
    out = records.mail(with_facts(src.read_mail(spark, f"{root}/*/artifacts")))
    return out.select("message", "event_type", "upload_id")


@query("a11_cloud_files", f"""SELECT 'Entra: ' || s_name || ' ->  from 9.9.9.9' AS message, 'u' || k % 2 AS upload_id {_SUPPLIER}""")
def cloud_files(spark, sf):
    """One capture's records as arrays, the other's as lines."""
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(F.col("s_name").alias("userPrincipalName"), F.lit("9.9.9.9").alias("ipAddress"), F.lit("2024-01-01T00:00:00Z").alias("createdDateTime")))
    rows = read(spark, sf, "supplier").groupBy((k % 2).alias("u"), (k % 8).alias("f")).agg(F.collect_list(body).alias("b"))
    value = F.when(F.col("u") == 0, F.concat(F.lit("["), F.concat_ws(",", "b"), F.lit("]"))).otherwise(F.concat_ws("\n", "b"))
    root = left(rows.select("u", value.alias("v")).repartition(8), F.col("v"), 2, "artifacts", F.col("u"), "a11")
    return records.cloud(with_facts(src.read_cloud(spark, f"{root}/*/artifacts/*"))).select("message", "upload_id")


@query("a12_sshd_journal", f"""SELECT '2024-01-01T00:00:00.000Z' AS at, 'sshd[' || k || ']: ' || CASE WHEN k % 2 = 0 THEN 'Accepted password for ' ELSE 'Failed password for ' END || s_name AS message, CASE WHEN k % 2 = 0 THEN 'logon_success' ELSE 'logon_failed' END AS event_type {_SUPPLIER}""")
def sshd_journal(spark, sf):
    k = F.col("s_suppkey")
    said = F.concat(F.when(k % 2 == 0, F.lit("Accepted password for ")).otherwise(F.lit("Failed password for ")), F.col("s_name"))
    line = F.to_json(F.struct(said.alias("MESSAGE"), text(k).alias("_PID"), F.lit("1704067200000000").alias("__REALTIME_TIMESTAMP")))
    rows = read(spark, sf, "supplier").select(F.explode(F.array(line, F.lit("no json"), F.lit("[1]"))).alias("v"), "s_suppkey")
    root = left(rows, F.col("v"), 2, "live", k, "a12")
    return linux.sshd_journal(with_facts(src.read_sshd_journal(spark, f"{root}/*/live"))).select(iso_ms(F.col("datetime")).alias("at"), "message", "event_type")


@query("a16_dash_tables", f"""SELECT 'Datastore: ' || s_name || ' (VMFS) at /v/' || k AS message, CAST(k AS VARCHAR) AS size {_SUPPLIER}""")
def dash_tables(spark, sf):
    """Three tables of one file each, one row a supplier."""
    k = F.col("s_suppkey")
    row = F.concat(F.rpad(F.concat(F.lit("/v/"), text(k)), 14, " "), F.rpad("s_name", 30, " "), F.lit("VMFS  "), text(k))
    head, dash = "Mount Point   Volume Name                   Type  Size", "------------  ----------------------------  ----  ----"
    rows = read(spark, sf, "supplier").groupBy((k % 3).alias("f")).agg(F.concat_ws("\n", F.lit(head), F.lit(dash), F.concat_ws("\n", F.collect_list(row))).alias("v"))
    root = left(rows.repartitionByRange(3, "f"), F.col("v"), 1, "live", F.col("f"), "a16")
    out = BUILDERS["esxi.filesystems"](with_facts(src.read_dash_tables(spark, f"{root}/*/live")))
    return out.select("message", F.col("attrs")["size"].alias("size"))


@query("a17_task_files", f"""SELECT '2024-01-01T00:00:00.000Z' AS at, 'Scheduled Task: ' || chr(92) || s_name || ' -> run.exe -n ' || k AS message, 'root' AS user_id {_SUPPLIER}""")
def task_files(spark, sf):
    k = F.col("s_suppkey")
    xml = F.concat(F.lit('<Task><RegistrationInfo><Date>2024-01-01T00:00:00Z</Date><URI>\\'), F.col("s_name"), F.lit(
        "</URI></RegistrationInfo><Actions><Exec><Command>run.exe</Command><Arguments>-n "), text(k), F.lit(
        "</Arguments></Exec></Actions><Principals><Principal><UserId>root</UserId></Principal></Principals></Task>"))
    root = shared_folder(spark, "a17")
    # Definitions of one key share a file. Tasks grow with the files by hundreds and move their
    # files into place themselves; the folder, not each of its files, is what is listed.
    one = read(spark, sf, "supplier").groupBy(k.alias("k")).agg(F.concat_ws("\n", F.collect_list(xml)).alias("value"))
    n = read(spark, sf, "supplier").count()
    one.repartition(n // FILES_A_TASK + 1).select("value").write.option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).text(f"{root}/u0/artifacts")
    out = records.task_definitions(with_facts(src.read_tasks(spark, f"{root}/*/artifacts")))
    return out.select(iso_ms(F.col("datetime")).alias("at"), "message", F.col("attrs")["user_id"].alias("user_id"))


@query("a19_sigma_files", f"""SELECT CASE WHEN k % 2 = 0 THEN 'Security' ELSE 'Other' END AS channel, CAST(k AS VARCHAR) AS record_number, s_name AS title, 'high' AS level, 'T1, T2' AS mitre {_SUPPLIER} WHERE k % 5 > 0""")
def sigma_files(spark, sf):
    k = F.col("s_suppkey")
    one = F.to_json(F.struct(F.lit("Sec").alias("Channel"), F.when(k % 5 > 0, text(k)).alias("RecordID"), F.col("s_name").alias("RuleTitle"), F.lit("HIGH").alias("Level"), F.array(F.lit("T1"), F.lit("T2")).alias("MitreAttack")))
    two = F.to_json(F.struct(F.lit("Other").alias("Channel"), F.when(k % 5 > 0, text(k)).alias("EvtxRecordId"), F.col("s_name").alias("RuleTitle"), F.lit("High").alias("Level"), F.lit("T1, T2").alias("MitreAttack")))
    root = left(read(spark, sf, "supplier"), F.when(k % 2 == 0, one).otherwise(two), 2, "live", k, "a19")
    return src.read_sigma(spark, f"{root}/*/live").select("channel", "record_number", "title", "level", "mitre")


@query("a20_report", "SELECT c_mktsegment AS segment, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1")
def report(spark, sf):
    out = shared_folder(spark, "a20")
    src.write_report(read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")), out, ["segment"])
    return spark.read.option("header", True).csv(out)


@query("a21_catalogue", "SELECT DISTINCT 'u' || s_suppkey % 3 AS upload, 'Tasks' AS folder, TRUE AS found FROM supplier")
def catalogue(spark, sf):
    root = left(read(spark, sf, "supplier"), F.col("s_name"), 3, "artifacts/Tasks", F.col("s_suppkey"), "a21")
    found = by_artifact(src.catalog(spark, root), r"^part-.*\.TXT$", r"artifacts\\tasks")
    return found.select(F.regexp_extract("path", r"^([^\\]+)\\", 1).alias("upload"), F.regexp_extract("path", r"\\([^\\]+)\\[^\\]+$", 1).alias("folder"), (F.col("size") > 0).alias("found")).distinct()
