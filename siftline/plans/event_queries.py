"""Event filters, sorting, paging, summaries and findings over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import filters as flt
from siftline.operators import findings, kept, paging, summaries
from siftline.operators.build import concat_events, emit
from siftline.plans.mapping import (
    WITH_EVENTS, WITH_FILES, WITH_PAGES, WITH_TIMELINE, file_timeline, raw_events, read, timeline, web_timeline,
)
from siftline.plans.registry import ORACLES, query
from siftline.session import shared_folder
from siftline.sources.timeline import event_json, parse_lines, save_events

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"
LOGONS = "event_type IN ('windows_logon', 'windows_authentication', 'windows_rdp', 'session_logon')"


def _ids(name: str, where: str, **filters) -> None:
    """Register one filter of the event query; the result is the event ids."""

    @query(name, f"{WITH_TIMELINE} SELECT id FROM tl WHERE {where}")
    def run(spark, sf):
        return flt.query_events(timeline(spark, sf), **filters).select("id")


_ids("d01_scope", "site_id = 's1' AND upload_id = 'u3'", site="s1", upload="u3")
_ids("d02_event_types", "event_type IN ('windows_process', 'account_created')", event_types=["windows_process", "account_created"])
_ids("d04_finding_none", "finding IS NULL", finding="none")
_ids("d04_finding_any", "finding IS NOT NULL", finding="any")
_ids("d04_finding_value", "finding = 'bad'", finding="bad")
_ids("d05_notable", "ct_significance = 'LikelyNotable'", notable=True)
_ids("d06_suspicious", "is_suspicious", suspicious=True)
_ids(
    "d07_time_range", "datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'",
    start="2024-01-05 00:00:00", end="2024-01-12 12:00:00",
)
_ids("d08_channel", "channel = 'System'", channel="System")
_ids("d09_attribute", "LogonType = '10' AND AuthenticationPackageName = 'NTLM'", data={"LogonType": "10", "AuthenticationPackageName": "NTLM"})
_ids("d10_field_top_level", "host_name = 'host3'", spec={"field": "host_name", "eq": "host3"})
_ids("d10_field_attribute", "TargetUserName = 'user7'", spec={"field": "TargetUserName", "eq": "user7"})
_ids(
    "d11_prefix", "lower(event_type) LIKE 'windows%' AND lower(TargetUserName) LIKE 'user1%'",
    spec={"and": [{"field": "event_type", "prefix": "WINDOWS"}, {"field": "TargetUserName", "prefix": "USER1"}]},
)
_ids("d12_message_contains", "lower(message) LIKE '%by user12%'", spec={"field": "message", "eq": "BY User12"})
_ids("d13_exists_attribute", "param1 IS NOT NULL", spec={"field": "param1", "exists": True})
_ids("d13_exists_top_level", "ct_significance IS NOT NULL", spec={"field": "ct_significance", "exists": True})
_ids("d14_boolean_field", "NOT is_suspicious", spec={"field": "is_suspicious", "eq": "maybe"})
_ids(
    "d15_and_or_not",
    "(event_type = 'windows_logon' OR channel = 'System') AND NOT (IpAddress = '-') AND NOT (lower(TargetDomainName) LIKE 'dom1%')",
    spec={"and": [
        {"or": [{"field": "event_type", "eq": "windows_logon"}, {"field": "channel", "eq": "System"}]},
        {"not": {"field": "IpAddress", "eq": "-"}}, {"not": {"field": "TargetDomainName", "prefix": "dom1"}},
    ]},
)


@query("d03_search_documents", r"""
SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')
 OR (list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'tion') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), 'ering'))
 OR contains(lower(lang), 'xx')""".replace("contains(lower(text), 'tion the')", "contains(lower(text), 'tion, ering')"))
def search_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    return docs.where(flt.search(docs, "tion, ering")).select("doc_id")


@query("d03_search_record", f"{WITH_TIMELINE} SELECT id FROM tl WHERE contains(lower(message), 'dom3') OR TargetDomainName = 'DOM3'")
def search_record(spark, sf):
    return flt.query_events(timeline(spark, sf), text="dom3").select("id")


@query("d16_hide_machines", f"""{WITH_TIMELINE}, u AS (SELECT TargetUserName AS username, max(CASE WHEN TargetDomainName NOT IN ('', '-') THEN TargetDomainName END) AS domain,
 string_agg(DISTINCT AuthenticationPackageName, ', ' ORDER BY AuthenticationPackageName) AS auth_packages FROM tl WHERE {LOGONS} GROUP BY 1)
SELECT username FROM u WHERE username NOT LIKE '%$' AND (contains(lower(username), 'dom4') OR contains(lower(domain), 'dom4') OR contains(lower(auth_packages), 'dom4'))""")
def hide_machines(spark, sf):
    return flt.hide_machine_accounts(summaries.logon_summary(timeline(spark, sf)), "DOM4").select("username")


@query("d17_jump", f"{WITH_TIMELINE} SELECT id FROM tl WHERE datetime BETWEEN TIMESTAMP '2024-01-10 10:15:00' AND TIMESTAMP '2024-01-10 11:15:59'")
def jump(spark, sf):
    start, end = flt.jump_window("2024-01-10", "10:15")
    return flt.query_events(timeline(spark, sf), start=start, end=end).select("id")


@query("d18_directory_name", f"{WITH_FILES} SELECT DISTINCT file_path AS dir, file_name AS name FROM ft WHERE coalesce(meta_type <> 'Dir', TRUE) AND contains(lower(file_name), 'ring.s')")
def directory_name(spark, sf):
    return flt.by_name(summaries.files_in(file_timeline(spark, sf)), "RING.S").select("dir", "name")


_VIEW_SQL = []
for _name, _v in flt.VIEWS.items():
    _tests = []
    if "event_types" in _v:
        _tests.append("event_type IN (" + ", ".join(f"'{t}'" for t in _v["event_types"]) + ")")
    if "channel" in _v:
        _tests.append(f"channel = '{_v['channel']}'")
    for _k, _x in _v.get("data", {}).items():
        _tests.append(f"{_k} = '{_x}'")
    if _v.get("notable"):
        _tests.append("ct_significance = 'LikelyNotable'")
    if _v.get("suspicious"):
        _tests.append("is_suspicious")
    if _v.get("finding") == "any":
        _tests.append("finding IS NOT NULL")
    elif _v.get("finding"):
        _tests.append(f"finding = '{_v['finding']}'")
    _VIEW_SQL.append(f"SELECT '{_name}' AS view, count(*) AS n, coalesce(sum(id), 0)::BIGINT AS ids FROM tl WHERE {' AND '.join(_tests)}")


@query("d19_views", f"{WITH_TIMELINE} " + " UNION ALL ".join(_VIEW_SQL))
def views(spark, sf):
    """All named views in one scan: each is a condition of the same pass."""
    df = timeline(spark, sf)
    names = []
    for name, spec in flt.VIEWS.items():
        tests = []
        if "event_types" in spec:
            tests.append(F.col("event_type").isin(spec["event_types"]))
        if "channel" in spec:
            tests.append(flt.attr(df, "channel") == spec["channel"])
        tests += [flt.attr(df, k) == v for k, v in spec.get("data", {}).items()]
        if spec.get("notable"):
            tests.append(F.col("ct_significance") == flt.NOTABLE)
        if spec.get("suspicious"):
            tests.append(F.col("is_suspicious"))
        if spec.get("finding"):
            tests.append(flt.finding_state(spec["finding"]))
        names.append((name, flt.all_of(tests)))
    aggs = [
        F.struct(F.lit(n).alias("view"), F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col("id"))), F.lit(0)).alias("ids"))
        for n, c in names
    ]
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


@query("d19_view_logons_failed", f"{WITH_TIMELINE} SELECT id FROM tl WHERE event_type = 'windows_logon' AND event_identifier = '4625'")
def view_failed(spark, sf):
    return flt.view(timeline(spark, sf), "logons.failed").select("id")


@query("d20_artifact_regex", f"{WITH_FILES} SELECT DISTINCT file_path AS path, file_name FROM ft WHERE regexp_matches(file_name, '(?i)\\.(sys|dll)$') AND regexp_matches(file_path, '(?i)BRAND1\\d')")
def artifact_regex(spark, sf):
    df = file_timeline(spark, sf)
    cat = df.select(F.col("attrs")["file_path"].alias("path"), F.col("attrs")["file_name"].alias("file_name")).distinct()
    return flt.by_artifact(cat, r"\.(sys|dll)$", r"BRAND1\d")


# ------------------------------------------------------------- sorting, paging

@query("e01_sort", f"{WITH_TIMELINE} SELECT id, row_number() OVER (ORDER BY coalesce(param1, '') DESC, id) AS pos FROM tl")
def sort_events(spark, sf):
    return paging.numbered(timeline(spark, sf), by="name", direction="desc").select("id", "pos")


@query("e02_page", f"{WITH_TIMELINE} SELECT id, datetime FROM (SELECT id, strftime(datetime, '{ISO}') AS datetime FROM tl ORDER BY tl.datetime DESC, id LIMIT 100 OFFSET 300)")
def page(spark, sf):
    return paging.page(timeline(spark, sf), 300, 100).select("id", summaries.iso_ms(F.col("datetime")).alias("datetime"))


@query("e02_page_info", f"{WITH_TIMELINE} SELECT count(*) AS total, 300 AS \"offset\", 5000 AS \"limit\", 5300 < count(*) AS has_more FROM tl WHERE event_type = 'windows_logon'")
def page_info(spark, sf):
    return paging.page_info(flt.query_events(timeline(spark, sf), event_types=["windows_logon"]), 300, 5000)


@query("e02_next_page", f"{WITH_TIMELINE} SELECT id FROM tl WHERE datetime <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY datetime DESC, id LIMIT 50")
def next_page(spark, sf):
    return paging.next_page(timeline(spark, sf), "2024-01-20 00:00:00", -1, 50).select("id")


@query("e03_top_five", f"{WITH_TIMELINE} SELECT TargetUserName AS usr, count(*) AS n FROM tl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_five(spark, sf):
    return paging.top_counts(timeline(spark, sf), F.col("attrs")["TargetUserName"], "usr")


@query("e04_counts_with_total", f"{WITH_TIMELINE} SELECT event_type, count(*) AS n FROM tl GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM tl")
def counts_with_total(spark, sf):
    return paging.counts_with_total(timeline(spark, sf), "event_type")


@query("e05_newest_per_group", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def newest_per_group(spark, sf):
    from siftline.operators.browsers import newest_per_group as newest

    orders = read(spark, sf, "orders")
    return newest(orders, ["o_custkey"], [F.col("o_orderdate").desc()], 3, tie=F.col("o_orderkey")).select("o_orderkey", "o_custkey")


@query("e06_first_children", f"""{WITH_FILES}, p AS (SELECT DISTINCT file_path AS dir, file_name AS child FROM ft),
r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY child) AS rn, count(*) OVER (PARTITION BY dir) AS c FROM p)
SELECT dir, string_agg(child, '|' ORDER BY child) AS children, greatest(max(c) - 3, 0) AS more FROM r WHERE rn <= 3 GROUP BY dir""")
def first_children(spark, sf):
    df = file_timeline(spark, sf)
    pairs = df.select(F.col("attrs")["file_path"].alias("dir"), F.col("attrs")["file_name"].alias("child"))
    return paging.first_children(pairs)


# ------------------------------------------------------------------- summaries

@query("f01_counters", f"{WITH_TIMELINE} SELECT count(*) AS total_events, count(*) FILTER (ct_significance = 'LikelyNotable') AS notable_count, count(*) FILTER (is_suspicious) AS suspicious_count FROM tl")
def counters(spark, sf):
    return summaries.counters(timeline(spark, sf))


@query("f02_count_by_type", f"{WITH_TIMELINE} SELECT event_type, count(*) AS n FROM tl GROUP BY 1")
def count_by_type(spark, sf):
    return summaries.count_by(timeline(spark, sf), "event_type")


@query("f03_count_by_finding", f"{WITH_TIMELINE} SELECT finding, count(*) AS n FROM tl WHERE finding IS NOT NULL GROUP BY 1")
def count_by_finding(spark, sf):
    return summaries.count_by(timeline(spark, sf), "finding")


@query("f04_logon_summary", f"""{WITH_TIMELINE}
SELECT coalesce(TargetUserName, 'unknown') AS username, count(*) AS total_events, count(*) FILTER (event_identifier = '4624') AS success_count,
 count(*) FILTER (event_identifier = '4625') AS fail_count, count(DISTINCT CASE WHEN IpAddress NOT IN ('', '-') THEN IpAddress END) AS unique_ips,
 strftime(min(datetime), '{ISO}') AS first_seen, strftime(max(datetime), '{ISO}') AS last_seen,
 coalesce(string_agg(DISTINCT AuthenticationPackageName, ', ' ORDER BY AuthenticationPackageName), '') AS auth_packages,
 coalesce(string_agg(DISTINCT LogonType, ', ' ORDER BY LogonType), '') AS logon_types,
 max(CASE WHEN TargetDomainName NOT IN ('', '-') THEN TargetDomainName END) AS domain
FROM tl WHERE {LOGONS} GROUP BY 1""")
def logon_summary(spark, sf):
    return summaries.logon_summary(timeline(spark, sf))


_FILES_SQL = f"""max(CAST(file_size AS BIGINT)) AS size, strftime(max(datetime), '{ISO}') AS latest_time, max(md5) AS md5, CAST(NULL AS VARCHAR) AS sha256,
 bool_or(coalesce(is_deleted = 'true', FALSE)) AS is_deleted, bool_or(timestompNote IS NOT NULL) AS has_timestomp, max(ct_significance) AS significance, bool_or(is_suspicious) AS is_suspicious"""


@query("f05_files_of_directories", f"{WITH_FILES} SELECT file_path AS dir, file_name AS name, {_FILES_SQL} FROM ft WHERE coalesce(meta_type <> 'Dir', TRUE) GROUP BY 1, 2")
def files_of_directories(spark, sf):
    return summaries.files_in(file_timeline(spark, sf))


@query("f05_list_directory", f"""{WITH_FILES} SELECT * FROM (SELECT DISTINCT file_name AS name, TRUE AS is_dir, CAST(NULL AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS latest_time, CAST(NULL AS VARCHAR) AS md5, CAST(NULL AS VARCHAR) AS sha256, CAST(NULL AS BOOLEAN) AS is_deleted, CAST(NULL AS BOOLEAN) AS has_timestomp, CAST(NULL AS VARCHAR) AS significance, CAST(NULL AS BOOLEAN) AS is_suspicious FROM ft WHERE file_path = '/c/brand7/small/' AND meta_type = 'Dir')
UNION ALL SELECT file_name AS name, FALSE AS is_dir, {_FILES_SQL} FROM ft WHERE file_path = '/c/brand7/small/' AND coalesce(meta_type <> 'Dir', TRUE) GROUP BY 1""")
def list_directory(spark, sf):
    return summaries.list_directory(file_timeline(spark, sf), "/C/Brand7/Small")


@query("f06_drives", f"{WITH_FILES} SELECT DISTINCT substr(file_path, 2, 1) AS name FROM ft WHERE regexp_matches(file_path, '^/[a-z]/$')")
def drives(spark, sf):
    return summaries.drives(file_timeline(spark, sf))


_TERMS = [t for _, _, ts in summaries.REMOTE_TOOLS for t in ts]
_TOOL_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(message), '{t}')" for t in ts) + f" THEN {i}"
    for i, (_, _, ts) in enumerate(summaries.REMOTE_TOOLS)
) + " END"
_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"
_TOOL_NAMES = "[" + ", ".join(f"'{n}'" for n, _, _ in summaries.REMOTE_TOOLS) + "]"
_TOOL_CATS = "[" + ", ".join(f"'{c}'" for _, c, _ in summaries.REMOTE_TOOLS) + "]"
_TOOLS_SQL = f"""{WITH_TIMELINE}, m AS (SELECT upload_id, event_type, datetime, 'ran ' || upper({_TERM_LIST}[k % {len(_TERMS)} + 1]) || ' and ' || {_TERM_LIST}[user_id % {len(_TERMS)} + 1] AS message FROM tl),
g AS (SELECT {_TOOL_CASE} AS tool, event_type, datetime FROM m)
"""


def _with_tool_messages(df):
    terms = F.array(*[F.lit(t) for t in _TERMS])
    one, two = F.get(terms, F.col("k") % len(_TERMS)), F.get(terms, F.col("user_id") % len(_TERMS))
    return df.withColumn("message", F.concat(F.lit("ran "), F.upper(one), F.lit(" and "), two))


@query("f07_remote_access", f"""{_TOOLS_SQL} SELECT {_TOOL_NAMES}[tool + 1] AS tool_name, {_TOOL_CATS}[tool + 1] AS category, count(*) AS event_count,
 string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, strftime(min(datetime), '{ISO}') AS first_seen, strftime(max(datetime), '{ISO}') AS last_seen
 FROM g WHERE tool IS NOT NULL GROUP BY tool""")
def remote_access(spark, sf):
    found = summaries.remote_access(_with_tool_messages(timeline(spark, sf)))
    return found.select(
        "tool_name", "category", "event_count", F.array_join("event_types", ",").alias("event_types"),
        summaries.iso_ms(F.col("first_seen")).alias("first_seen"), summaries.iso_ms(F.col("last_seen")).alias("last_seen"),
    )


def _kept(spark, df, name):
    """The event table and the place of its kept summaries."""
    table, store = shared_folder(spark, f"{name}-events"), shared_folder(spark, f"{name}-kept")
    save_events(df, table)
    return table, store


@query("f08_cached_read", f"""{_TOOLS_SQL} SELECT {_TOOL_NAMES}[tool + 1] AS tool_name, {_TOOL_CATS}[tool + 1] AS category, CAST(count(*) AS BIGINT) AS event_count,
 string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, strftime(min(datetime), '{ISO}') AS first_seen, strftime(max(datetime), '{ISO}') AS last_seen
 FROM g WHERE tool IS NOT NULL GROUP BY tool""")
def cached_read(spark, sf):
    table, store = _kept(spark, _with_tool_messages(timeline(spark, sf)), "f08")
    kept.refresh(spark, table, store)
    found = kept.cached_remote_access(spark, table, store)
    return found.select(
        "tool_name", "category", "event_count", F.array_join("event_types", ",").alias("event_types"),
        summaries.iso_ms(F.col("first_seen")).alias("first_seen"), summaries.iso_ms(F.col("last_seen")).alias("last_seen"))


@query("f08_refresh", ORACLES["f04_logon_summary"])
def refreshed_logons(spark, sf):
    """Kept for half of the events, then renewed for the captures that get the rest:
    the same as the summary of all events."""
    df = timeline(spark, sf)
    table, store = _kept(spark, df.where("seq % 2 = 0 OR upload_id IN ('u1', 'u5')"), "f08r")
    kept.refresh(spark, table, store)
    save_events(df.where("upload_id NOT IN ('u1', 'u5')"), table)
    kept.refresh(spark, table, store)
    return kept.kept_logons(kept.states(spark, store, "logons"))


@query("d03_search_stored", ORACLES["d03_search_record"])
def search_stored(spark, sf):
    """The same search over the stored events, reading only captures that may match."""
    table, store = _kept(spark, timeline(spark, sf), "d03")
    return kept.search_events(spark, table, store, "dom3").select(F.col("seq").alias("id"))


@query("f09_remote_headline", f"""{_TOOLS_SQL}, t AS (SELECT {_TOOL_CATS}[tool + 1] AS category, count(*) AS n FROM g WHERE tool IS NOT NULL GROUP BY tool, 1)
SELECT count(*) AS total_tools, sum(n)::BIGINT AS total_events, count(*) FILTER (category IN ('Dual-Use / Suspicious', 'Tunneling', 'Lateral Movement')) AS suspicious_count FROM t""")
def remote_headline(spark, sf):
    return summaries.remote_headline(summaries.remote_access(_with_tool_messages(timeline(spark, sf))))


@query("f10_platform_summary", """
SELECT coalesce(CASE WHEN c_nationkey % 5 > 0 THEN c_mktsegment END, 'unknown') AS platform, count(DISTINCT c_custkey) AS upload_count, coalesce(sum(n), 0)::BIGINT AS event_count
FROM (SELECT c.*, o.n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey) WHERE c_custkey % 4 > 0 GROUP BY 1""")
def platform_summary(spark, sf):
    n = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("event_count"))
    customers = read(spark, sf, "customer")
    uploads = customers.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("upload_id"), F.when(F.col("c_nationkey") % 5 > 0, F.col("c_mktsegment")).alias("platform"),
        F.when(F.col("c_custkey") % 4 > 0, F.lit("complete")).otherwise(F.lit("pending")).alias("status"), "event_count",
    )
    return summaries.platform_summary(uploads)


@query("f11_site_list", """
SELECT n_nationkey AS site_id, n_name AS name, coalesce(u.c, 0) AS upload_count, coalesce(e.c, 0) AS event_count FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) u ON u.c_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) e ON e.c_nationkey = n_nationkey""")
def site_list(spark, sf):
    customers = read(spark, sf, "customer")
    sites = read(spark, sf, "nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("name"))
    events = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return summaries.site_list(
        sites, customers.select(F.col("c_nationkey").alias("site_id")), events.select(F.col("c_nationkey").alias("site_id"))
    )


@query("f12_close_out", f"{WITH_TIMELINE} SELECT upload_id, count(*) AS event_count, coalesce(arg_min(host_name, seq) FILTER (host_name <> ''), '') AS host_name FROM tl GROUP BY 1")
def close_out(spark, sf):
    return summaries.close_out(timeline(spark, sf))


@query("f22_quality_check", """
SELECT count(*) AS lines, count(*) FILTER (conv_id % 7 = 0) AS invalid_json, count(*) FILTER (conv_id % 7 <> 0 AND turn % 3 = 0) AS missing_datetime,
 count(*) FILTER (conv_id % 7 <> 0 AND turn % 2 = 0) AS missing_timestamp_desc, count(*) FILTER (conv_id % 7 <> 0 AND text = '') AS missing_message FROM conversations""")
def quality_check(spark, sf):
    turn = F.col("turn")
    body = F.to_json(F.struct(
        F.when(turn % 3 != 0, F.lit("2024-01-01T00:00:00.000Z")).alias("datetime"),
        F.when(turn % 2 == 0, F.lit("")).otherwise(F.lit("d")).alias("timestamp_desc"), F.col("text").alias("message"),
    ))
    lines = read(spark, sf, "conversations").select(F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("line"))
    return summaries.quality_check(lines)


# ---------------------------------------------------- dedupe, union, findings

@query("c01_emit", f"""{WITH_TIMELINE}, d AS (SELECT * FROM tl UNION ALL SELECT * REPLACE (id + 1000000 AS id, seq + 1000000 AS seq) FROM tl WHERE k % 3 = 0)
SELECT arg_min(id, seq) AS id, count(*) AS copies FROM (SELECT *, date_trunc('hour', datetime) AS h FROM d) GROUP BY upload_id, h, timestamp_desc, message, event_type""".replace("SELECT arg_min(id, seq) AS id, count(*) AS copies", "SELECT arg_min(id, seq) AS id, min(seq) AS seq"))
def emit_events(spark, sf):
    df = timeline(spark, sf).drop("finding", "finding_note").withColumn("datetime", F.date_trunc("hour", "datetime"))
    copy = df.where(F.col("k") % 3 == 0).withColumn("id", F.col("id") + 1000000).withColumn("seq", F.col("seq") + 1000000)
    return emit(df.unionByName(copy)).select("id", "seq")


@query("i01_concat", f"{WITH_TIMELINE}, ft AS ({WITH_FILES.removeprefix('WITH ft AS (').removesuffix(')')}), wt AS ({WITH_PAGES.removeprefix('WITH wt AS (').removesuffix(')')}) SELECT event_type, count(*) AS n FROM (SELECT event_type FROM tl UNION ALL SELECT event_type FROM ft UNION ALL SELECT event_type FROM wt) GROUP BY 1")
def concat_all(spark, sf):
    frames = [timeline(spark, sf), file_timeline(spark, sf), web_timeline(spark, sf)]
    return concat_events(frames).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("i02_distinct_paths", f"{WITH_FILES} SELECT DISTINCT file_path AS path FROM ft")
def distinct_paths(spark, sf):
    return file_timeline(spark, sf).select(F.col("attrs")["file_path"].alias("path")).distinct()


_LOG_SQL = """lg AS (SELECT site_id, id AS event_id, 1 AS seq, 'bad' AS finding, 'first' AS note FROM tl WHERE k % 2 = 0
 UNION ALL SELECT site_id, id, 2, 'good', NULL FROM tl WHERE k % 3 = 0 UNION ALL SELECT site_id, id, 3, NULL, NULL FROM tl WHERE k % 5 = 0),
cur AS (SELECT event_id, arg_max(coalesce(finding, '~'), seq) AS finding, arg_max(coalesce(note, '~'), seq) AS note FROM lg GROUP BY 1)"""


def _log(df):
    def marked(cond, seq, finding, note):
        part = df.where(cond)
        return part.select("site_id", F.col("id").alias("event_id"), F.lit(seq).cast("long").alias("seq"),
                           F.lit(finding).cast("string").alias("finding"), F.lit(note).cast("string").alias("finding_note"))

    k = F.col("k")
    return marked(k % 2 == 0, 1, "bad", "first").unionByName(marked(k % 3 == 0, 2, "good", None)).unionByName(marked(k % 5 == 0, 3, None, None))


@query("l01_current_findings", f"{WITH_TIMELINE}, {_LOG_SQL} SELECT id, nullif(cur.finding, '~') AS finding, CASE WHEN cur.finding <> '~' THEN nullif(cur.note, '~') END AS finding_note FROM tl LEFT JOIN cur ON event_id = id")
def current(spark, sf):
    df = timeline(spark, sf)
    return findings.with_findings(df, _log(df)).select("id", "finding", "finding_note")


@query("l02_mark_many", f"{WITH_TIMELINE} SELECT id, CASE WHEN k % 4 = 0 THEN 'suspicious' END AS finding, CASE WHEN k % 4 = 0 THEN 'batch' END AS finding_note FROM tl")
def mark_many(spark, sf):
    df = timeline(spark, sf)
    parts = [
        findings.mark(df.where((F.col("site_id") == s) & (F.col("k") % 4 == 0)).select(F.col("id").alias("event_id")), s, "suspicious", "batch", 1)
        for s in ("s0", "s1")
    ]
    return findings.with_findings(df, parts[0].unionByName(parts[1])).select("id", "finding", "finding_note")


@query("l03_delete_captures", f"{WITH_TIMELINE} SELECT id FROM tl WHERE upload_id NOT IN ('u1', 'u4', 'u6')")
def delete_captures(spark, sf):
    df = timeline(spark, sf)
    doomed = df.where(F.col("upload_id").isin("u1", "u4", "u6")).select("upload_id")
    return findings.delete_captures(df, doomed).select("id")


@query("a01_parse_timeline", f"""{WITH_TIMELINE} SELECT id, strftime(datetime, '{ISO}') AS datetime, event_type, nullif(host_name, '') AS host_name, coalesce(is_suspicious, FALSE) AS is_suspicious FROM tl WHERE k % 6 <> 0""")
def parse_timeline(spark, sf):
    df = event_json(timeline(spark, sf), "body")
    k, body = F.col("k"), F.col("body")
    lines = df.select(
        "upload_id", "site_id", "seq",
        F.when(k % 12 == 0, F.lit("{broken")).when(k % 12 == 6, F.lit('{"datetime":"noon","message":"x"}'))
        .when(k % 12 == 1, F.replace(body, F.lit('"event_type"'), F.lit('"x\\u0007":"y","event_type"'))).otherwise(body).alias("line"),
    )
    good, _ = parse_lines(lines)
    return good.select(
        F.col("seq").alias("id"), summaries.iso_ms(F.col("datetime")).alias("datetime"), "event_type", "host_name", "is_suspicious"
    )


@query("a01_rejected_lines", f"""{WITH_EVENTS} SELECT CASE WHEN k % 12 = 0 THEN 'not a JSON object' ELSE 'unreadable datetime' END AS reason, count(*) AS n FROM ev WHERE k % 6 = 0 GROUP BY 1""")
def rejected_lines(spark, sf):
    df = raw_events(spark, sf)
    k = F.col("k")
    lines = df.select(
        F.lit("u").alias("upload_id"), F.lit("s").alias("site_id"), F.col("id").alias("seq"),
        F.when(k % 12 == 0, F.lit("[1]")).when(k % 12 == 6, F.lit('{"datetime":"noon"}'))
        .otherwise(F.lit('{"datetime":"2024-01-01T00:00:00.000Z"}')).alias("line"),
    )
    return parse_lines(lines)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
