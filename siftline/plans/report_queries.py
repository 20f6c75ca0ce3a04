"""Session, policy-share, collected-file and software reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import inventory, sessions
from siftline.plans.mapping import WITH_FILES, WITH_SESSIONS, file_timeline, read, session_timeline
from siftline.functions.values import attribute_map
from siftline.plans.registry import query

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"

# ------------------------------------------------------------------- sessions

_CONNECTION = """CASE WHEN event_type = 'windows_rdp' AND Address = 'LOCAL' THEN 'Interactive Console' WHEN event_type IN ('windows_rdp', 'rdp_connection') THEN 'RDP'
 WHEN LogonType = '10' THEN 'RDP' WHEN LogonType = '2' AND coalesce(IpAddress, '') IN ('-', '', '127.0.0.1', '::1') THEN 'Interactive Console' WHEN LogonType = '2' THEN 'RDP'
 WHEN LogonType = '3' THEN 'Network' ELSE 'Unknown' END"""
_BASE = f"""{WITH_SESSIONS}, f AS (SELECT *, event_identifier AS eid, {_CONNECTION} AS conn, regexp_replace(user_name, '^[^\\\\]*\\\\', '') AS acct FROM st),
ls AS (SELECT upload_id, TargetLogonId AS logon_id, arg_max(SessionID, seq) FILTER (onn AND SessionID IS NOT NULL) AS session_id, arg_max(TargetUserName, seq) FILTER (onn) AS username,
 arg_max(TargetDomainName, seq) FILTER (onn AND TargetDomainName IS NOT NULL) AS domain, arg_max(CASE WHEN IpAddress <> '-' OR IpAddress IS NULL THEN coalesce(IpAddress, '') END, seq) FILTER (onn AND (IpAddress <> '-' OR IpAddress IS NULL)) AS source_ip,
 arg_max(WorkstationName, seq) FILTER (onn AND WorkstationName IS NOT NULL) AS ws, arg_max(host_name, seq) FILTER (onn) AS hostname, arg_max(LogonType, seq) FILTER (onn) AS logon_type,
 max(datetime) FILTER (onn) AS logon_time, max(datetime) FILTER (NOT onn) AS logoff_time, arg_min(conn, seq) FILTER (onn) AS conn,
 list_distinct(list(eid)) AS ids FROM (SELECT *, eid IN ('4624', '4672') AS onn FROM f WHERE event_type = 'windows_logon' AND eid IN ('4624', '4672', '4634', '4647')) GROUP BY 1, 2),
tu AS (SELECT upload_id, SessionID AS session_id, acct AS username, list_distinct(list(eid)) AS t_ids, max(datetime) FILTER (eid = '23') AS t_logoff, max(datetime) FILTER (eid = '21') AS t_logon, arg_min(conn, seq) AS t_conn
 FROM f WHERE event_type = 'windows_rdp' AND SessionID IS NOT NULL GROUP BY 1, 2, 3),
ts AS (SELECT upload_id, SessionID AS session_id, arg_max(acct, seq) AS username, max(datetime) FILTER (eid = '21') AS logon_time, max(datetime) FILTER (eid = '23') AS logoff_time, arg_max(conn, seq) AS conn
 FROM f WHERE event_type = 'windows_rdp' AND SessionID IS NOT NULL GROUP BY 1, 2),
al AS (SELECT upload_id, logon_id, session_id, username, domain, source_ip, ws, hostname, logon_type, coalesce(logon_time, t_logon) AS logon_time, greatest(coalesce(logoff_time, t_logoff), coalesce(t_logoff, logoff_time)) AS logoff_time,
  coalesce(conn, t_conn) AS conn, list_distinct(list_concat(ids, coalesce(t_ids, []))) AS ids, 'EventLog' AS data_source FROM ls LEFT JOIN tu USING (upload_id, session_id, username)
 UNION ALL SELECT upload_id, 'rdp_' || session_id, session_id, username, '', NULL, NULL, NULL, '10', logon_time, logoff_time, conn, ['rdp_terminal'], 'EventLog' FROM ts
  WHERE logon_time IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.upload_id = ts.upload_id AND ls.session_id = ts.session_id AND ls.username = ts.username)
 UNION ALL SELECT upload_id, coalesce(local_user, '') || '@' || entries || '@' || strftime(datetime, '{ISO}'), NULL, arg_max(coalesce(username, local_user), seq), NULL, NULL, any_value(entries), any_value(host_name), '10', datetime, NULL, 'RDP', ['registry'], 'Registry'
  FROM f WHERE event_type = 'rdp_connection' GROUP BY upload_id, local_user, entries, datetime),
hs AS (SELECT * REPLACE (CASE WHEN coalesce(conn, 'Unknown') <> 'Unknown' THEN conn WHEN logon_type = '2' THEN 'Interactive Console' ELSE 'RDP' END AS conn) FROM al
 WHERE coalesce(conn, 'Unknown') <> 'Network' AND (coalesce(conn, 'Unknown') <> 'Unknown' OR coalesce(logon_type IN ('2', '10'), FALSE))),
rep AS (SELECT * FROM hs UNION ALL SELECT upload_id, '', NULL, TargetUserName, TargetDomainName, CASE WHEN IpAddress <> '-' THEN IpAddress END, WorkstationName, host_name, LogonType, datetime, NULL, 'Failed Logon', ['4625'], 'EventLog'
 FROM f WHERE event_type = 'windows_logon' AND eid = '4625' AND LogonType IN ('2', '10'))"""


@query("f18_logon_sessions", f"""{_BASE} SELECT upload_id, logon_id, session_id, username, nullif(source_ip, '') AS source_ip, logon_type, strftime(logon_time, '{ISO}') AS logon_time, strftime(logoff_time, '{ISO}') AS logoff_time, conn AS connection_type, array_to_string(list_sort(ids), ',') AS event_ids FROM ls""")
def logon_sessions(spark, sf):
    out = sessions.logon_sessions(sessions._fields(session_timeline(spark, sf)))
    return out.select(
        "upload_id", "logon_id", "session_id", "username", F.when(F.col("source_ip") != "", F.col("source_ip")).alias("source_ip"), "logon_type",
        sessions.iso_ms(F.col("logon_time")).alias("logon_time"), sessions.iso_ms(F.col("logoff_time")).alias("logoff_time"), "connection_type",
        F.array_join(F.array_sort("event_ids"), ",").alias("event_ids"),
    )


@query("f19_connection_type", f"{_BASE} SELECT id, conn AS connection_type FROM f")
def connection_type(spark, sf):
    df = session_timeline(spark, sf)
    a = F.col("attrs")
    kind = sessions.connection_type(F.col("event_type"), F.coalesce(a["LogonType"], F.lit("")), F.coalesce(a["Address"], F.lit("")), F.coalesce(a["IpAddress"], F.lit("")))
    return df.select("id", kind.alias("connection_type"))


@query("f20_failed_logons", f"{_BASE} SELECT TargetUserName AS username, strftime(datetime, '{ISO}') AS at, LogonType AS logon_type, CASE WHEN IpAddress <> '-' THEN IpAddress END AS source_ip FROM f WHERE event_type = 'windows_logon' AND eid = '4625' AND LogonType IN ('2', '10')")
def failed_logons(spark, sf):
    out = sessions.failed_logons(sessions._fields(session_timeline(spark, sf)))
    return out.select("username", sessions.iso_ms(F.col("logon_time")).alias("at"), "logon_type", F.when(F.col("source_ip") != "", F.col("source_ip")).alias("source_ip"))


@query("g13_session_report", f"""{_BASE} SELECT upload_id, coalesce(session_id, '') AS session_id, logon_id, conn AS connection_type, coalesce(username, '') AS username, coalesce(domain, '') AS domain, coalesce(source_ip, '') AS source_ip,
 coalesce(ws, '') AS workstation_name, coalesce(hostname, '') AS hostname, coalesce(strftime(logon_time, '{ISO}'), '') AS logon_time, coalesce(strftime(logoff_time, '{ISO}'), '') AS logoff_time,
 CAST(trunc((epoch_ms(logoff_time) - epoch_ms(logon_time)) / 1000.0) AS BIGINT) AS duration_seconds, coalesce(logon_type, '') AS logon_type, array_to_string(list_sort(ids), ',') AS event_ids, data_source FROM rep""")
def session_report(spark, sf):
    return sessions.session_report(session_timeline(spark, sf)).select(
        "upload_id", "session_id", "logon_id", "connection_type", "username", "domain", "source_ip", "workstation_name", "hostname",
        "logon_time", "logoff_time", "duration_seconds", "logon_type", "event_ids", "data_source",
    )


@query("f21_session_summary", f"""{_BASE} SELECT 'type' AS facet, conn AS value, count(*) AS n FROM rep GROUP BY 2 UNION ALL SELECT 'source', data_source, count(*) FROM rep GROUP BY 2
 UNION ALL SELECT 'with', 'duration', count(*) FROM rep WHERE conn <> 'Failed Logon' AND trunc((epoch_ms(logoff_time) - epoch_ms(logon_time)) / 1000.0) <> 0""")
def session_summary(spark, sf):
    return sessions.session_summary(sessions.session_report(session_timeline(spark, sf)))


# --------------------------------------------------------------- policy share

_GUIDS = 40
_POLICY = f"""{WITH_FILES}, pe AS (SELECT *, '/c/SYSVOL/domain/Policies/{{AB-' || (l_partkey % {_GUIDS}) || '}}/' || CASE WHEN l_suppkey % 2 = 0 THEN 'Machine/' ELSE '' END || file_name AS path, '{{AB-' || (l_partkey % {_GUIDS}) || '}}' AS policy FROM ft WHERE l_partkey % 3 = 0)"""


def _policy_events(spark, sf):
    df = file_timeline(spark, sf)
    guid = F.concat(F.lit("{AB-"), (F.col("l_partkey") % _GUIDS).cast("string"), F.lit("}"))
    name = F.col("attrs")["file_name"]
    on_share = F.concat(F.lit("/c/SYSVOL/domain/Policies/"), guid, F.lit("/"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("Machine/")).otherwise(F.lit("")), name)
    path = F.when(F.col("l_partkey") % 3 == 0, on_share).otherwise(F.concat(F.lit("/c/other/"), name))
    return df.withColumn("attrs", attribute_map({"filePath": path, "fileName": name, "fileSize": F.col("attrs")["file_size"]}))


# The same path in two captures is two paths.
@query("f15_policy_totals", f"""{_POLICY}, dirs AS (SELECT DISTINCT upload_id, unnest(['/c', '/c/SYSVOL', '/c/SYSVOL/domain', '/c/SYSVOL/domain/Policies', '/c/SYSVOL/domain/Policies/' || policy, CASE WHEN l_suppkey % 2 = 0 THEN '/c/SYSVOL/domain/Policies/' || policy || '/Machine' END]) AS d FROM pe)
SELECT upload_id, count(*) AS entries, count(DISTINCT path) AS paths, count(DISTINCT policy) AS policies, any_value(n) AS directories FROM pe JOIN (SELECT upload_id, count(d) AS n FROM dirs GROUP BY 1) USING (upload_id) GROUP BY 1""")
def policy_totals(spark, sf):
    return inventory.policy_totals(inventory.policy_entries(_policy_events(spark, sf)))


@query("f15_policies", f"""{_POLICY} SELECT upload_id, policy, count(*) AS files, count(*) FILTER (contains(lower(file_name), 'user') OR contains(lower(file_name), 'machine')) AS key_files,
 strftime(min(datetime) FILTER (timestamp_desc LIKE '%Created%'), '{ISO}') AS created, strftime(max(datetime) FILTER (timestamp_desc LIKE '%Modified%' OR timestamp_desc LIKE '%Changed%'), '{ISO}') AS modified FROM pe GROUP BY 1, 2""")
def policies(spark, sf):
    return inventory.policies(inventory.policy_entries(_policy_events(spark, sf)))


@query("f15_policy_facets", f"""{_POLICY} SELECT upload_id, 'time' AS facet, timestamp_desc AS value, count(*) AS n FROM pe GROUP BY 1, 3 UNION ALL
 SELECT upload_id, 'extension', CASE l_partkey % 6 WHEN 0 THEN '.exe' WHEN 1 THEN '.dll' WHEN 2 THEN '.sys' WHEN 3 THEN '.txt' WHEN 4 THEN '.gz' ELSE '(no extension)' END, count(*) FROM pe GROUP BY 1, 3""")
def policy_facets(spark, sf):
    return inventory.policy_facets(inventory.policy_entries(_policy_events(spark, sf)))


@query("f15_policy_tree", f"""{_POLICY}, parts AS (SELECT DISTINCT upload_id, string_split(path, '/') AS p FROM pe), steps AS (SELECT DISTINCT upload_id, array_to_string(p[1:i], '/') AS dir, array_to_string(p[1:i+1], '/') AS child FROM parts, unnest(range(1, len(p))) AS t(i)),
 r AS (SELECT *, row_number() OVER (PARTITION BY upload_id, dir ORDER BY child) AS rn, count(*) OVER (PARTITION BY upload_id, dir) AS c FROM steps WHERE dir <> '') SELECT upload_id, dir, string_agg(child, '|' ORDER BY child) AS children, greatest(max(c) - 3, 0) AS more FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def policy_tree(spark, sf):
    return inventory.policy_tree(inventory.policy_entries(_policy_events(spark, sf)))


# ------------------------------------------------------------- collected files

_COLLECTED = f"""{WITH_FILES}, c AS (SELECT *, file_path || file_name AS p, CASE WHEN timestamp_desc LIKE '%FN)' THEN NULL WHEN timestamp_desc LIKE '%Created%' THEN 'C' WHEN timestamp_desc LIKE '%Modified%' THEN 'M' WHEN timestamp_desc LIKE '%Accessed%' THEN 'A' ELSE 'H' END AS kind FROM ft WHERE file_content_status = 'Collected'),
g AS (SELECT upload_id, p AS file_path, arg_min(file_name, seq) AS file_name, arg_min(file_size, seq) AS file_size, arg_min(coalesce(md5, '~'), seq) AS md5, min(datetime) FILTER (kind = 'C') AS created, max(datetime) FILTER (kind = 'M') AS modified,
 max(datetime) FILTER (kind = 'A') AS accessed, max(datetime) FILTER (kind = 'H') AS changed FROM c GROUP BY 1, 2)"""


def _collected(spark, sf):
    df = file_timeline(spark, sf)
    a = F.col("attrs")
    whole = F.map_concat(F.map_filter("attrs", lambda k, _: k != "file_path"), F.create_map(F.lit("file_path"), F.concat(a["file_path"], a["file_name"])))
    return inventory.collected_files(df.withColumn("attrs", whole))


@query("f16_collected_files", f"""{_COLLECTED} SELECT upload_id, file_path, file_name, file_size, nullif(md5, '~') AS md5, strftime(created, '{ISO}') AS date_created, strftime(modified, '{ISO}') AS date_modified, strftime(accessed, '{ISO}') AS date_accessed, strftime(changed, '{ISO}') AS date_changed FROM g""")
def collected_files(spark, sf):
    return _collected(spark, sf).select("upload_id", "file_path", "file_name", "file_size", "md5", "date_created", "date_modified", "date_accessed", "date_changed")


@query("f16_collected_summary", f"{_COLLECTED} SELECT count(*) AS files, count(created) AS with_created, count(modified) AS with_modified, sum(CAST(file_size AS BIGINT))::BIGINT AS total_size, count(*) FILTER (md5 <> '~') AS with_hash FROM g")
def collected_summary(spark, sf):
    return inventory.collected_summary(_collected(spark, sf))


# -------------------------------------------------------------------- software

_SOFTWARE = """WITH e AS (SELECT 'u' || (o_orderkey % 4) AS upload_id, o_orderkey AS seq, o_custkey % 500 AS prog, o_orderkey % 3 > 0 AS reg, CASE WHEN o_custkey % 500 % 4 = 0 THEN 'P' || (o_custkey % 500) END AS code, 'App ' || (o_custkey % 500) AS name,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Pub' || (o_custkey % 500) END AS publisher0, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '1.' || (o_orderkey % 10) END AS version, o_orderdate AS d FROM orders),
k AS (SELECT *, CASE WHEN code IS NOT NULL THEN publisher0 ELSE 'Pub' || prog END AS publisher FROM e),
kk AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'msi:' || lower(code) ELSE 'name:' || lower(name) || '|publisher:' || lower(publisher) END AS key FROM k),
g AS (SELECT upload_id, key, min(seq) FILTER (reg) AS fr, min(seq) FILTER (NOT reg) AS fi, arg_max(publisher, seq) FILTER (NOT reg AND publisher IS NOT NULL) AS ip, arg_min(publisher, seq) FILTER (reg AND publisher IS NOT NULL) AS rp,
 arg_max(version, seq) FILTER (NOT reg AND version IS NOT NULL) AS iv, arg_min(coalesce(version, '~'), seq) FILTER (reg) AS rv, arg_max(d, seq) FILTER (NOT reg) AS idt, arg_min(d, seq) FILTER (reg) AS rdt FROM kk GROUP BY 1, 2)"""
_SOFT_OUT = """SELECT upload_id, key, coalesce(ip, rp, '') AS publisher, coalesce(iv, CASE WHEN fi IS NULL OR coalesce(fr < fi, FALSE) THEN nullif(rv, '~') END, '') AS version,
 CASE WHEN fi IS NULL THEN 'Registry' WHEN fr < fi THEN 'Both' ELSE 'Amcache' END AS data_source, strftime(coalesce(idt, rdt), '%Y-%m-%dT%H:%M:%S.%gZ') AS install_date FROM g"""


def _software(spark, sf):
    o = read(spark, sf, "orders")
    key, prog = F.col("o_orderkey"), F.col("o_custkey") % 500
    reg, code = key % 3 > 0, F.when(prog % 4 == 0, F.concat(F.lit("P"), prog.cast("string")))
    name = F.concat(F.lit("App "), prog.cast("string"))
    pub = F.concat(F.lit("Pub"), prog.cast("string"))
    publisher = F.when(code.isNull() | (key % 5 != 0), pub)
    df = o.select(
        F.concat(F.lit("u"), (key % 4).cast("string")).alias("upload_id"), key.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("datetime"), F.lit("host").alias("host_name"),
        F.when(reg, F.lit("registry_software")).otherwise(F.lit("installed_program")).alias("event_type"), F.lit("x").alias("data_type"),
        attribute_map({
            "msi_product_code": code, "software_name": F.when(reg, name), "program_name": F.when(~reg, name), "publisher": publisher,
            "version": F.when(key % 7 != 0, F.concat(F.lit("1."), (key % 10).cast("string"))),
        }).alias("attrs"),
    )
    return inventory.software_inventory(df)


@query("f17_software_inventory", f"{_SOFTWARE} {_SOFT_OUT}")
def software_inventory(spark, sf):
    return _software(spark, sf).select("upload_id", "key", "publisher", "version", "data_source", "install_date")


@query("f17_software_summary", f"""{_SOFTWARE}, o AS ({_SOFT_OUT}) SELECT data_source, count(*) AS programs, count(*) FILTER (version <> '') AS with_version, count(*) FILTER (install_date <> '') AS with_install_date, count(*) FILTER (publisher <> '') AS with_publisher, count(*) FILTER (key LIKE 'msi:%') AS with_product_code FROM o GROUP BY 1""")
def software_summary(spark, sf):
    return inventory.software_summary(_software(spark, sf))
