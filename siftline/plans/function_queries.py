"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import labels, text, times, values
from siftline.functions.patterns import domain_glob_column, path_glob_column
from siftline.operators.inventory import time_kind
from siftline.plans.mapping import WITH_EVENTS, WITH_FILES, WITH_TIMELINE, file_timeline, raw_events, read, timeline
from siftline.plans.registry import query

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def _micros(name: str):
    return F.unix_micros(F.col(name))


# ------------------------------------------------------------------ timestamps

@query("b01_normalize_ts", f"""{WITH_EVENTS}, t AS (
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS base, k, CASE k % 6
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:00' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || (k % 10)
  WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.1234567Z' WHEN 3 THEN 'on ' || strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN '  ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw FROM ev)
SELECT id, CASE k % 6 WHEN 0 THEN base || '.000Z' WHEN 1 THEN base || '.' || (k % 10) || '00Z' WHEN 2 THEN base || '.123Z'
  WHEN 3 THEN NULL ELSE base || '.000Z' END AS normalized FROM t""")
def normalize(spark, sf):
    df = raw_events(spark, sf)
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("k")
    raw = (
        F.when(k % 6 == 0, F.concat(base, F.lit("+05:00")))
        .when(k % 6 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("."), (k % 10).cast("string")))
        .when(k % 6 == 2, F.concat(base, F.lit(".1234567Z")))
        .when(k % 6 == 3, F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd")))
        .when(k % 6 == 4, F.concat(F.lit("  "), base, F.lit("Z "))).otherwise(base)
    )
    return df.select("id", times.normalize_ts(raw).alias("normalized"))


@query("b01_normalize_ts_offset", f"""{WITH_EVENTS}
SELECT id, strftime(date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '{ISO}') AS shifted FROM ev""")
def normalize_offset(spark, sf):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return raw_events(spark, sf).select("id", times.normalize_ts(raw, apply_offset=True).alias("shifted"))


@query("b02_epoch_ms", f"""{WITH_EVENTS}
SELECT id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('millisecond', ts)) END AS us FROM ev""")
def epoch_ms(spark, sf):
    ms = F.unix_millis("ts").cast("string")
    k = F.col("k")
    raw = F.when(k % 4 == 0, F.lit("0")).when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(ms)
    return raw_events(spark, sf).select("id", F.unix_micros(times.epoch_ms(raw)).alias("us"))


@query("b03_epoch_seconds", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS us FROM ev""")
def epoch_seconds(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit(-1)).otherwise(F.unix_seconds("ts"))
    return raw_events(spark, sf).select("id", F.unix_micros(times.epoch_seconds(raw)).alias("us"))


@query("b04_filetime", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM ev""")
def filetime(spark, sf):
    ticks = _micros("ts") * 10 + F.lit(times.FILETIME_UNIX_TICKS) + F.col("k") % 10
    raw = F.when(F.col("k") % 5 == 0, F.col("k").cast("long")).otherwise(ticks)
    return raw_events(spark, sf).select("id", F.unix_micros(times.filetime(raw)).alias("us"))


@query("b05_webkit", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM ev""")
def webkit(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(_micros("ts") + F.lit(times.WEBKIT_UNIX_MICROS))
    return raw_events(spark, sf).select("id", F.unix_micros(times.webkit_micros(raw)).alias("us"))


@query("b06_mozilla", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM ev""")
def mozilla(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(_micros("ts"))
    return raw_events(spark, sf).select("id", F.unix_micros(times.unix_micros(raw)).alias("us"))


@query("b07_mac_absolute", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) + 500000 END AS us FROM ev""")
def mac_absolute(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit(0.0)).otherwise(
        F.unix_seconds("ts").cast("double") - times.MAC_UNIX_SECONDS + 0.5
    )
    return raw_events(spark, sf).select("id", F.unix_micros(times.mac_absolute(raw)).alias("us"))


@query("b08_ole_date", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('day', ts)) + 21600000000 END AS us FROM ev""")
def ole_date(spark, sf):
    days = F.unix_date(F.to_date("ts")) + times.OLE_UNIX_DAYS + F.lit(0.25)
    raw = F.when(F.col("k") % 5 == 0, F.lit(1.0)).otherwise(days)
    return raw_events(spark, sf).select("id", F.unix_micros(times.ole_date(raw)).alias("us"))


@query("b09_journal_micros", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM ev""")
def journal(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit("n/a")).otherwise(_micros("ts").cast("string"))
    return raw_events(spark, sf).select("id", F.unix_micros(times.unix_micros(raw)).alias("us"))


@query("b10_install_date", f"""{WITH_EVENTS}
SELECT id, CASE k % 8 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
  WHEN 2 THEN epoch_us(date_trunc('second', ts)) WHEN 3 THEN epoch_us(date_trunc('second', ts)) WHEN 4 THEN epoch_us(date_trunc('day', ts))
  WHEN 5 THEN epoch_us(date_trunc('day', ts)) WHEN 6 THEN epoch_us(date_trunc('second', ts)) ELSE NULL END AS us FROM ev""")
def install_date(spark, sf):
    formats = [
        "yyyyMMdd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd",
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    ]
    chain = F.when(F.col("k") % 8 == 7, F.lit("soon"))
    for i, f in enumerate(formats):
        chain = chain.when(F.col("k") % 8 == i, F.date_format("ts", f))
    return raw_events(spark, sf).select("id", F.unix_micros(times.install_date(chain)).alias("us"))


@query("b10_login_list_date", f"""{WITH_EVENTS}
SELECT id, epoch_us(date_trunc('second', ts)) AS us FROM ev""")
def login_list_date(spark, sf):
    raw = F.concat(F.lit("Thu "), F.date_format("ts", "MMM d HH:mm:ss yyyy"))
    return raw_events(spark, sf).select("id", F.unix_micros(times.login_list_date(raw)).alias("us"))


@query("b10_history_date", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('minute', ts)) END AS us FROM ev""")
def history_date(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "M/d/yy, h:mm a"))
    return raw_events(spark, sf).select("id", F.unix_micros(times.history_date(raw)).alias("us"))


@query("b11_seconds_or_filetime", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 2 = 0 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('second', ts)) END AS us FROM ev""")
def seconds_or_filetime(spark, sf):
    seconds = F.unix_seconds("ts")
    raw = F.when(F.col("k") % 2 == 0, seconds).otherwise(seconds * 10000000 + F.lit(times.FILETIME_UNIX_TICKS))
    return raw_events(spark, sf).select("id", F.unix_micros(times.seconds_or_filetime(raw)).alias("us"))


# ----------------------------------------------------------- values and labels

@query("b12_strip_escapes", r"""
SELECT doc_id, md5(replace(text, 'e', '')) AS h FROM documents""")
def strip_escapes(spark, sf):
    marked = F.replace(F.col("text"), F.lit("e"), F.lit("\\u0007"))
    return read(spark, sf, "documents").select("doc_id", F.md5(text.strip_control_escapes(marked)).alias("h"))


@query("b13_loose_boolean", f"""{WITH_EVENTS}
SELECT id, k % 5 IN (0, 1) AS flag FROM ev""")
def loose_boolean(spark, sf):
    k = F.col("k")
    raw = F.when(k % 5 == 0, F.lit("TRUE")).when(k % 5 == 1, F.lit("true")).when(k % 5 == 2, F.lit("1")).when(k % 5 == 3, F.lit("no"))
    return raw_events(spark, sf).select("id", values.loose_boolean(raw).alias("flag"))


@query("b14_first_non_empty", f"""{WITH_TIMELINE}
SELECT id, coalesce(nullif(host_name, ''), nullif(IpAddress, ''), 'none') AS v FROM tl""")
def first_non_empty(spark, sf):
    df = timeline(spark, sf)
    return df.select("id", F.coalesce(values.first_non_empty(F.col("host_name"), F.col("attrs")["IpAddress"]), F.lit("none")).alias("v"))


@query("b15_drop_empty_attributes", f"""{WITH_TIMELINE}
SELECT id, CAST((CASE WHEN host_name <> '' THEN 1 ELSE 0 END) + (CASE WHEN param1 IS NOT NULL THEN 1 ELSE 0 END) + 1 AS BIGINT) AS kept FROM tl""")
def drop_empty(spark, sf):
    df = timeline(spark, sf)
    bag = values.attribute_map({"a": F.col("host_name"), "b": F.col("attrs")["param1"], "c": F.col("message")})
    return df.select("id", F.size(bag).cast("long").alias("kept"))


@query("b16_ellipsis", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS cut,
  CASE WHEN length(l) > 80 THEN substr(l, 1, 80) || '...' ELSE l END AS first_line
FROM (SELECT doc_id, text, regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^([^\n]*)', 1) AS l FROM documents)""")
def ellipsis(spark, sf):
    body = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id", text.ellipsis(body, 200).alias("cut"), text.one_line(body, 80).alias("first_line")
    )


@query("b17_human_bytes", f"""
SELECT l_orderkey, l_partkey, l_linenumber, n, CASE WHEN n >= 1073741824 THEN printf('%.1fGB', round_even(n / 1073741824.0, 1))
  WHEN n >= 1048576 THEN printf('%.1fMB', round_even(n / 1048576.0, 1)) WHEN n >= 1024 THEN printf('%.1fKB', round_even(n / 1024.0, 1))
  ELSE n || 'B' END AS shown
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * power(7, l_linenumber * 1.5) AS BIGINT) AS n FROM lineitem)""".replace("CAST(CAST(l_quantity AS BIGINT) * power(7, l_linenumber * 1.5) AS BIGINT)", "CAST(l_quantity AS BIGINT) * (l_partkey + 1) * (CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 1000 ELSE 40000 END)"))
def human_bytes(spark, sf):
    scale = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 10).when(F.col("l_linenumber") == 3, 1000).otherwise(40000)
    n = F.col("l_quantity").cast("long") * (F.col("l_partkey") + 1) * scale
    return read(spark, sf, "lineitem").withColumn("n", n).select(
        "l_orderkey", "l_partkey", "l_linenumber", "n", text.human_bytes(F.col("n")).alias("shown")
    )


@query("b18_human_time", """
SELECT l_orderkey, l_partkey, l_linenumber,
 CASE WHEN s > 3600 THEN printf('%.1fh', round_even(s / 3600.0, 1)) WHEN s > 60 THEN printf('%.1fm', round_even(s / 60.0, 1)) ELSE printf('%.0fs', round_even(s::DOUBLE, 0)) END AS cpu,
 CASE WHEN s >= 3600 THEN printf('%.1fh', round_even(s / 3600.0, 1)) WHEN s >= 60 THEN printf('%.1fm', round_even(s / 60.0, 1)) ELSE s || 's' END AS duration
FROM (SELECT *, l_partkey * l_linenumber AS s FROM lineitem)""")
def human_time(spark, sf):
    seconds = F.col("l_partkey") * F.col("l_linenumber")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", text.human_cpu(seconds * 10000000).alias("cpu"),
        text.human_duration(seconds).alias("duration"),
    )


@query("b19_split_host_port", f"""{WITH_EVENTS}
SELECT id, CASE k % 4 WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN 'fe80::' || k WHEN 2 THEN '*' ELSE 'localhost' END AS host,
  CASE k % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '*' ELSE '' END AS port FROM ev""")
def split_host_port(spark, sf):
    k, u = F.col("k"), F.col("user_id").cast("string")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), k.cast("string"), F.lit(":"), u))
        .when(k % 4 == 1, F.concat(F.lit("[fe80::"), k.cast("string"), F.lit("]:"), u))
        .when(k % 4 == 2, F.lit(" *:* ")).otherwise(F.lit("localhost"))
    )
    host, port = text.split_host_port(raw)
    return raw_events(spark, sf).select("id", host.alias("host"), port.alias("port"))


@query("b20_split_domain_user", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 2 = 0 THEN 'DOM' || (k % 3) ELSE '' END AS domain, 'user' || user_id AS usr FROM ev""")
def split_domain_user(spark, sf):
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit("DOM"), (F.col("k") % 3).cast("string"), F.lit("\\"), user)).otherwise(user)
    domain, name = text.split_domain_user(raw)
    return raw_events(spark, sf).select("id", domain.alias("domain"), name.alias("usr"))


@query("b21_paths", """
SELECT p_partkey, '/c/' || lower(p_type) || '/' || lower(replace(p_name, ' ', '/')) AS low,
 '/c/' || lower(p_type) || '/' || lower(split_part(p_name, ' ', 1)) || '/' AS parent, split_part(p_name, ' ', 2) || '.TXT' AS base,
 'txt' AS ext, split_part(p_name, ' ', 2) AS stem FROM part""".replace("lower(replace(p_name, ' ', '/')) AS low", "lower(replace(p_name, ' ', '/')) || '.txt' AS low"))
def paths(spark, sf):
    raw = F.concat(F.lit("C:\\"), F.col("p_type"), F.lit("\\"), F.replace(F.col("p_name"), F.lit(" "), F.lit("\\")), F.lit(".TXT"))
    base = text.base_name(raw)
    return read(spark, sf, "part").select(
        "p_partkey", F.lower(text.drive_path(raw)).alias("low"), text.parent_dir(raw).alias("parent"), base.alias("base"),
        text.extension(base).alias("ext"), text.without_extension(base).alias("stem"),
    )


@query("b22_url_host", """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?]*)', 1) AS host,
 regexp_extract(url, '^[a-z]+://([^/:?]*)', 1) AS bare FROM pages""")
def url_host(spark, sf):
    schemeless = F.concat(F.regexp_replace("url", "^[a-z]+://([^/]*)/", "$1:8080/"), F.lit("?x=1"))
    return read(spark, sf, "pages").select(
        "page_id", text.url_host(F.col("url")).alias("host"), text.url_host(schemeless).alias("bare")
    )


@query("b23_mac_address", """
SELECT c_custkey, upper(substr(h,1,2)||':'||substr(h,3,2)||':'||substr(h,5,2)||':'||substr(h,7,2)||':'||substr(h,9,2)||':'||substr(h,11,2)) AS mac
FROM (SELECT c_custkey, substr(md5(c_name), 1, 12) AS h FROM customer)""")
def mac_address(spark, sf):
    h = F.substring(F.md5("c_name"), 1, 12)
    raw = F.when(F.col("c_custkey") % 2 == 0, h).otherwise(F.regexp_replace(h, "^(..)(..)(..)(..)(..)(..)$", "$1-$2-$3-$4-$5-$6"))
    return read(spark, sf, "customer").select("c_custkey", F.upper(text.mac_address(raw)).alias("mac"))


@query("b24_rot13", """
SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS h FROM documents""")
def rot13(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.rot13(F.col("text"))).alias("h"))


@query("b25_sid_rid", f"""{WITH_EVENTS}
SELECT id, 'S-1-5-21-' || user_id || '-' || (1000 + k) AS sid, CAST(1000 + k AS INTEGER) AS rid FROM ev""")
def sid_rid(spark, sf):
    sid = F.concat(F.lit("S-1-5-21-"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") + 1000).cast("string"))
    path = F.when(F.col("k") % 2 == 0, F.concat(F.lit("c/$Recycle.Bin/"), sid, F.lit("/x"))).otherwise(F.concat(F.lit("C:\\u\\"), sid, F.lit("\\y")))
    return raw_events(spark, sf).select("id", text.sid_of_path(path).alias("sid"), text.rid_of_sid(text.sid_of_path(path)).alias("rid"))


@query("b26_snake_case", """
SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || '__' || lower(split_part(p_name, ' ', 2)) || '_' || lower(substr(p_type, 1, 1)) || '_' || lower(substr(p_type, 2, 1)) AS snake FROM part""")
def snake_case(spark, sf):
    raw = F.concat(
        F.split("p_name", " ")[0], F.lit(" "), F.initcap(F.split("p_name", " ")[1]), F.substring("p_type", 1, 2)
    )
    return read(spark, sf, "part").select("p_partkey", text.snake_case(raw).alias("snake"))


@query("b27_globs", """
SELECT page_id, regexp_matches(h, '(?i)^(.*\\.)?example\\.' || t || '$') AS any_depth,
 regexp_matches(h, '(?i)^(.[^.]*\\.)?example\\.' || t || '$') AS one_label, regexp_matches(u, '(?i).*/' || substr(l, 1, 2) || '[^/]*') AS path_hit
FROM (SELECT page_id, url AS u, regexp_extract(url, '://([^/:?]*)', 1) AS h, ['com','net','org'][page_id % 3 + 1] AS t, ['en','fr','de'][page_id % 3 + 1] AS l FROM pages)""")
def globs(spark, sf):
    df = read(spark, sf, "pages").withColumn("h", text.url_host(F.col("url")))
    i = (F.col("page_id") % 3).cast("int")
    glob = F.concat(F.lit("**.example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), i))
    path = F.concat(F.lit("**/"), F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), i), F.lit("*"))
    return df.select(
        "page_id",
        F.regexp_like("h", F.concat(F.lit("(?i)"), domain_glob_column(glob))).alias("any_depth"),
        F.regexp_like("h", F.concat(F.lit("(?i)"), domain_glob_column(glob, True))).alias("one_label"),
        F.regexp_like("url", F.concat(F.lit("(?i)"), path_glob_column(path))).alias("path_hit"),
    )


@query("b28_fill_template", f"""{WITH_TIMELINE}
SELECT id, 'User ' || TargetUserName || ' at ' || coalesce(IpAddress, '${{ip_address}}') || ' (' || event_type || ') ${{nothing}}' AS shown FROM tl""")
def fill_template(spark, sf):
    from siftline.functions.patterns import fill_template as fill

    df = timeline(spark, sf)
    renamed = F.map_filter(
        F.create_map(
            F.lit("TargetUserName"), F.col("attrs")["TargetUserName"], F.lit("ip_address"), F.col("attrs")["IpAddress"],
            F.lit("event_type"), F.col("event_type"),
        ), lambda _, v: v.isNotNull(),
    )
    template = F.lit("User ${payload.TargetUserName} at ${ip_address} (${event_type|upper}) ${nothing}")
    return df.select("id", fill(template, renamed).alias("shown"))


@query("b29_redact", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[REDACTED]' ELSE c_name END AS shown FROM customer""")
def redact(spark, sf):
    name = F.when(F.col("c_custkey") % 6 == 0, F.lit("API_Token")).when(F.col("c_custkey") % 3 == 0, F.lit("my_PASSWORD")).otherwise(F.lit("HOME"))
    return read(spark, sf, "customer").select("c_custkey", text.redact_secret(name, F.col("c_name")).alias("shown"))


@query("b30_logon_type", f"""{WITH_EVENTS}
SELECT id, CASE k % 13 WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' WHEN 4 THEN 'Batch' WHEN 5 THEN 'Service' WHEN 7 THEN 'Unlock'
 WHEN 8 THEN 'NetworkCleartext' WHEN 9 THEN 'NewCredentials' WHEN 10 THEN 'RemoteInteractive' WHEN 11 THEN 'CachedInteractive'
 ELSE 'Type ' || (k % 13) END AS label FROM ev""")
def logon_type(spark, sf):
    return raw_events(spark, sf).select("id", labels.logon_type((F.col("k") % 13).cast("string")).alias("label"))


@query("b31_channels", f"""{WITH_TIMELINE}
SELECT id, CASE channel WHEN 'Security' THEN 'Microsoft-Windows-Security-Auditing' WHEN 'System' THEN 'Microsoft-Windows-Kernel-General'
 ELSE 'Microsoft-Windows-Sysmon' END AS provider,
 CASE WHEN event_identifier IN ('4624','4625','4688','4720','5156') THEN 'Security' END AS by_id,
 CASE WHEN k % 2 = 0 THEN 'Security' ELSE 'Other' END AS full_name,
 CASE WHEN k % 2 = 0 THEN 'PowerShell' ELSE 'Microsoft-Windows-Foo' END AS fallback FROM tl""")
def channels(spark, sf):
    df = timeline(spark, sf)
    odd = F.col("k") % 2 == 1
    return df.select(
        "id", labels.provider(F.col("attrs")["channel"]).alias("provider"),
        labels.channel_of_event_id(F.col("attrs")["event_identifier"].try_cast("int")).alias("by_id"),
        labels.full_channel(F.when(odd, F.lit("Other")).otherwise(F.lit("Sec"))).alias("full_name"),
        labels.provider(F.when(odd, F.lit("Microsoft-Windows-Foo/Operational")).otherwise(F.lit("my windows powershell log"))).alias("fallback"),
    )


@query("b32_platform", f"""{WITH_EVENTS}
SELECT id, ['macos','linux','esxi','windows',NULL][k % 5 + 1] AS platform FROM ev""")
def platform(spark, sf):
    sources = ["Collector-macOS", "x-linux-y", "ESXi host", "CT-Registry", "mail"]
    raw = F.get(F.array(*[F.lit(s) for s in sources]), F.col("k") % 5)
    return raw_events(spark, sf).select("id", labels.platform_of_source(raw).alias("platform"))


@query("b33_code_labels", f"""{WITH_EVENTS}
SELECT id, coalesce(['denied','unknown','allowed','limited','added_modified_by_user'][k % 7 + 1], 'auth_' || (k % 7)) AS permission,
 coalesce(['Public','Private','Domain'][k % 4 + 1], 'Unknown') AS network,
 CASE k % 40 WHEN 10 THEN 'New Lease' WHEN 11 THEN 'Renewed Lease' WHEN 12 THEN 'Released Lease' WHEN 13 THEN 'Duplicate IP' WHEN 14 THEN 'Lease Expired'
  WHEN 15 THEN 'Lease Denied' WHEN 17 THEN 'Lease Expired/Deleted' WHEN 18 THEN 'Lease Expired/Deactivated' WHEN 20 THEN 'BOOTP Lease'
  WHEN 30 THEN 'DNS Update Request' WHEN 31 THEN 'DNS Update Failed' WHEN 32 THEN 'DNS Update Success' WHEN 36 THEN 'Lease Deleted (Cleanup)'
  ELSE 'DHCP Event ' || (k % 40) END AS lease,
 CASE k % 20 WHEN 5 THEN 'File/Document Opened' WHEN 10 THEN 'Clipboard Activity' WHEN 11 THEN 'Settings Changed' WHEN 16 THEN 'Application Launched'
  ELSE 'Windows Timeline Activity' END AS activity FROM ev""")
def code_labels(spark, sf):
    k = F.col("k")
    return raw_events(spark, sf).select(
        "id", labels.permission_state(k % 7).alias("permission"), labels.network_category(k % 4).alias("network"),
        labels.dhcp_code(k % 40).alias("lease"), labels.activity_description(k % 20).alias("activity"),
    )


@query("b34_first_application", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '[{"platform":"x"}]' ELSE p_name END AS app FROM part""")
def first_application(spark, sf):
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit('[{"application":""},{"application":"'), F.col("p_name"), F.lit('"}]')))
        .when(k == 1, F.lit('[{"platform":"x"}]')).otherwise(F.col("p_name"))
    )
    return read(spark, sf, "part").select("p_partkey", values.first_application(raw).alias("app"))


@query("b35_add_tags", f"""{WITH_EVENTS}
SELECT id, CASE k % 3 WHEN 0 THEN 'a|sigma' WHEN 1 THEN 'sigma|a' ELSE 'a|sigma' END AS tags FROM ev""")
def add_tags(spark, sf):
    k = F.col("k")
    old = F.when(k % 3 == 0, F.array(F.lit("a"))).when(k % 3 == 1, F.array(F.lit("sigma"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    return raw_events(spark, sf).select("id", F.array_join(values.add_tags(old, F.lit("sigma")), "|").alias("tags"))


@query("b36_highest", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 3 = 0 THEN 'NOTABLE' WHEN k % 3 = 1 THEN 'LIKELY_NOTABLE' ELSE 'AAA' END AS score,
 CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'low' END AS level FROM ev""")
def highest(spark, sf):
    k = F.col("k")
    scores = (
        F.when(k % 3 == 0, F.array(F.lit("UNKNOWN"), F.lit("NOTABLE"))).when(k % 3 == 1, F.array(F.lit("LIKELY_NOTABLE"), F.lit("UNKNOWN")))
        .otherwise(F.array(F.lit("BBB"), F.lit("AAA")))
    )
    levels = F.when(k % 2 == 0, F.array(F.lit("medium"), F.lit("critical"))).otherwise(F.array(F.lit("informational"), F.lit("low")))
    return raw_events(spark, sf).select(
        "id", values.highest(scores, values.SCORE_RANK).alias("score"), values.highest(levels, values.LEVEL_RANK).alias("level")
    )


@query("b37_join_capped", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 9 > 5 THEN 'n1; n2; n3; n4; n5 (+' || (k % 9 - 5) || ' more)' ELSE array_to_string(list_transform(range(1, k % 9 + 1), lambda x: 'n' || x), '; ') END AS shown FROM ev""")
def join_capped(spark, sf):
    n = (F.col("k") % 9).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("n"), i.cast("string")))).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return raw_events(spark, sf).select("id", text.join_capped(items).alias("shown"))


@query("b38_flatten", f"""{WITH_EVENTS}
SELECT id, CAST(k AS VARCHAR) AS props_k, kind AS props_kind, CAST(user_id AS VARCHAR) AS usr, CAST(3 AS BIGINT) AS n FROM ev""")
def flatten(spark, sf):
    df = raw_events(spark, sf)
    inner = F.struct(F.col("k").cast("string").alias("k"), F.col("kind").alias("kind"))
    body = F.to_json(F.struct(F.col("user_id").alias("user"), inner.alias("props"), F.array(F.lit(1)).alias("list")))
    flat = values.flatten_one_level(values.parse_map(body))
    return df.select(
        "id", flat["props_k"].alias("props_k"), flat["props_kind"].alias("props_kind"), flat["user"].alias("usr"),
        F.size(flat).cast("long").alias("n"),
    )


@query("c14_analysis_results", f"""{WITH_EVENTS}
SELECT id, CASE WHEN k % 2 = 0 THEN 'LikelyNotable' ELSE 'LikelyNotable,Notable' END AS sig, 'T1059,T1003' AS mitre,
 kind || ' | ' || k AS why FROM ev""")
def analysis_results(spark, sf):
    df = raw_events(spark, sf)
    second = F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.lit("Notable"))
    body = F.to_json(F.array(
        F.struct(F.lit("LikelyNotable").alias("significance"), F.col("kind").alias("justification"), F.array(F.lit("T1059"), F.lit("")).alias("mitreAttackIds")),
        F.struct(second.alias("significance"), F.col("k").cast("string").alias("justification"), F.array(F.lit("T1003")).alias("mitreAttackIds")),
    ))
    out = values.analysis_attributes(body)
    return df.select("id", out["ct_significance"].alias("sig"), out["mitre_attack_ids"].alias("mitre"), out["ct_justification"].alias("why"))


@query("f16_time_kind", f"""{WITH_FILES}
SELECT timestamp_desc, CASE WHEN timestamp_desc LIKE '%($FN)' THEN NULL WHEN timestamp_desc LIKE '%Created%' THEN 'Created'
 WHEN timestamp_desc LIKE '%Modified%' THEN 'Modified' WHEN timestamp_desc LIKE '%Accessed%' THEN 'Accessed' WHEN timestamp_desc LIKE '%Changed%' THEN 'Changed' END AS kind,
 count(*) AS n FROM ft GROUP BY 1, 2""")
def kinds(spark, sf):
    return file_timeline(spark, sf).groupBy("timestamp_desc", time_kind(F.col("timestamp_desc")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
