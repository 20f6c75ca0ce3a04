"""Detection rules, Sigma detections and correlation over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftline.operators import correlate, detect
from siftline.plans.mapping import WITH_EVENTS, WITH_FILES, WITH_PAGES, WITH_TIMELINE, file_timeline, raw_events, read, timeline, web_timeline
from siftline.plans.registry import query
from siftline.sources.rules import RuleSet, current_rules, prepare_rules

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def result(kind: str, score: str, why: str = "", mitre: tuple = ()) -> dict:
    return {
        "analysisResultType": kind, "score": score, "justification": why,
        "mitreAttackTypes": [{"id": m, "title": ""} for m in mitre],
    }


# A small rule set of every plugin, in the shape of a rule file.
RULES = [
    ("FC1", "FileCorrelatedCloudRulePlugin_v1", {"rules": [
        {"matches": {"fileName": r"^(cold|red)_ring\.(?!zip)", "extensions": ["exe", "^sys$"], "dataTypes": ["FILE"]},
         "result": result("SUSPICIOUS_FILE", "LIKELY_NOTABLE", "File ${file_name} in ${file_path}", ("T1036",))},
        {"matches": {"path": "/brand1[0-3]/", "fileNameNoExt": "widget$"}, "result": result("ODD_PATH", "UNKNOWN", "path")},
        {"matches": {"sources": "CT-MFT"}, "result": result("NEVER", "NOTABLE")},
    ]}),
    ("FC2", "FileCorrelatedCloudRulePlugin_v1", {"rules": [
        {"matches": {"fileName": "^rclone", "arguments": [r"\Q-nop\E", "hidden"], "path": "temp/"},
         "result": result("EXFILTRATION_TOOL", "NOTABLE", "${process_name} run by ${payload.TargetUserName}", ("T1567", "T1048"))},
    ]}),
    ("PS1", "PowershellArgsCloudRulePlugin_v1", {"rules": [
        {"argToken": "-EncodedCommand", "result": result("POWERSHELL_ARGS", "LIKELY_NOTABLE", "encoded", ("T1059",))},
        {"argToken": "-w hidden", "result": result("POWERSHELL_ARGS", "UNKNOWN", "hidden")},
    ]}),
    ("EM1", "EventsMatchingCloudRulePlugin_v1", {"rules": [
        {"matches": {"eventIds": [4625, 4624], "logFileName": r"Security\.evtx", "payload": {"LogonType": "^(3|10)$", "TargetUserName": r"user1\d\b"}},
         "result": result("LOGON", "UNKNOWN", "logon type ${LogonType}")},
        {"matches": {"eventIds": [5156], "logNames": "Sysmon"}, "result": result("NETWORK", "LIKELY_NOTABLE", "")},
        {"matches": {"logNames": "Security"}, "result": result("NO_IDS", "NOTABLE", "")},
    ]}),
    ("DO1", "DomainCloudRulePlugin_v1", {"domains": [
        {"serviceProvider": "Mega", "domainStarPattern": "**.mega.example", "newResultARData": result("EXFIL_DOMAIN", "LIKELY_NOTABLE", "mega", ("T1567",))},
        {"serviceProvider": "Org", "domainStarPattern": "**.example.org", "newResultARData": result("EXFIL_DOMAIN", "UNKNOWN", "org")},
        {"serviceProvider": "Blog", "domainStarPattern": "blog.*.example.*", "newResultARData": result("BLOG", "UNKNOWN", "blog")},
        {"serviceProvider": "Transfer", "domainStarPattern": "**.transfer.test", "newResultARData": result("EXFIL_DOMAIN", "NOTABLE", "transfer")},
    ]}),
    ("RM1", "RemoteManagementCloudRulePlugin_v1", {"rules": [
        {"rmmRecord": {"id": "AnyDesk"}, "matchesPath": [
            {"fileName": "anydesk.exe", "path": "C:/Windows/**"}, {"fileNameNoExt": "anydesk_portable"},
        ]},
        {"rmmRecord": {"id": "RingTool"}, "matchesPath": [{"fileNameNoExt": "cold_ring", "extensions": ["dll"]}]},
    ]}),
    ("ET1", "ExecutableTypeCloudRulePlugin_v1", {"rules": [
        {"record": {"id": "Rclone", "newResult": result("TRANSFER_TOOL", "NOTABLE", "rclone")}, "matches": [{"fileName": "Rclone.exe"}]},
        {"record": {"id": "TarBall", "newResult": result("ARCHIVE", "UNKNOWN", "tar")}, "matches": [{"fileName": "red_gear.tar.gz", "dataTypes": ["FILE"]}]},
    ]}),
    ("LD1", "LibNotOnDiskCloudRulePlugin_v1", {"rules": [
        {"libToMatch": {"path": "/c/brand2?/*/", "fileNameNoExt": "blue_*"}, "analysisResultData": {"score": "LIKELY_NOTABLE", "justification": "Library {0}"}},
        {"libToMatch": {"path": "**/economy/**", "extensions": ["sys"]}, "analysisResultData": {"score": "UNKNOWN", "justification": "driver"}},
    ]}),
    ("IM1", "AnalysisResultImpactMappingCloudRulePlugin_v1", {"entries": [
        {"analysisResultType": "EXFIL_DOMAIN", "impact": "Exfiltration"}, {"analysisResultType": "POWERSHELL_ARGS", "impact": "Execution"},
    ]}),
    ("HX1", "HayabusaCloudRulePlugin_v1", {"excludeRulesLines": [{"guid": "rule-3"}]}),
    ("CB1", "CommonBitsJobDomainCloudRulePlugin_v1", {"commonBitsJobDomains": [{"host": r"^a\.b\.mega"}]}),
    ("HP1", "HostPortExclusionCloudRulePlugin_v1", {"excludedHostPorts": [{"host": "transfer", "port": 443}]}),
]


#: A rule set of the usual size, and a domain feed.
BULK, FEED = 60, 10_000


def bulk_rules(n: int, globs: int) -> list[tuple]:
    """`n` rules of each of six plugins and `globs` domain globs that look at all events
    and hit none of the test tables."""
    file_keys = ("fileName", "fileNameNoExt", "path", "parentProcess", "taskName")
    many = [
        ("FileCorrelatedCloudRulePlugin_v1", "rules", [
            {"matches": {file_keys[i % 5]: rf"(?:bulk|mass)[_-]tool{i}\b", "extensions": ["exe", "dll"], "arguments": [f"--bulk{i}"][:i % 2]},
             "result": result("BULK", "NOTABLE", "${file_name}")} for i in range(n)]),
        ("PowershellArgsCloudRulePlugin_v1", "rules", [{"argToken": f"-bulk{i}", "result": result("BULK", "NOTABLE")} for i in range(n)]),
        ("EventsMatchingCloudRulePlugin_v1", "rules", [
            {"matches": {"eventIds": [4624, 20_000 + i], "logNames": "Security", "payload": {"TargetUserName": rf"^bulk{i}\$"}},
             "result": result("BULK", "NOTABLE")} for i in range(n)]),
        ("RemoteManagementCloudRulePlugin_v1", "rules", [
            {"rmmRecord": {"id": f"Bulk{i}"}, "matchesPath": [{"fileName": f"bulk{i}.exe"}, {"fileNameNoExt": f"mass{i}", "path": "/opt/**"}]} for i in range(n)]),
        ("ExecutableTypeCloudRulePlugin_v1", "rules", [
            {"record": {"id": f"Bulk{i}", "newResult": result("BULK", "UNKNOWN")}, "matches": [{"fileName": f"bulk{i}.exe"}]} for i in range(n)]),
        ("LibNotOnDiskCloudRulePlugin_v1", "rules", [
            {"libToMatch": {"path": f"/bulk{i}/**"}, "analysisResultData": {"score": "UNKNOWN", "justification": "{0}"}} for i in range(n)]),
        ("DomainCloudRulePlugin_v1", "domains", [
            {"serviceProvider": "Feed", "domainStarPattern": f"**.feed{i}.invalid" if i % 50 else f"cdn*.feed{i}.invalid", "newResultARData": result("FEED", "UNKNOWN")}
            for i in range(globs)]),
    ]
    return [(f"BULK{k}", plugin, {name: rules}) for k, (plugin, name, rules) in enumerate(many)]


def rule_set(spark, bulk: int = BULK, globs: int = BULK) -> RuleSet:
    """The rules above among a bulk of others, through the same preparation as a
    rule file."""
    rows = [(i, rid, 1, plugin, True, json.dumps(body), True) for i, (rid, plugin, body) in enumerate(RULES + bulk_rules(bulk, globs))]
    schema = "rule_order int, rule_id string, version int, plugin string, enabled boolean, payload string, has_metadata boolean"
    return prepare_rules(spark, spark.createDataFrame(rows, schema))


def _hits(df, rules, plugin, **options):
    return detect.detections(detect.detect(df, rules, (plugin,), **options), ["id"])


_STEM = "regexp_replace({0}, '^(.+)\\.[^.]*$', '\\1')"
_EXT = "lower(regexp_extract({0}, '\\.([^.]+)$', 1))"


@query("g02_file_rules", f"""{WITH_FILES}
SELECT id, 'FC1' AS rule_id, 'SUSPICIOUS_FILE' AS analysis_type, file_name AS tool_name, 'File ' || file_name || ' in ' || file_path AS justification FROM ft
 WHERE regexp_matches(file_name, '(?i)^(cold|red)_ring\\.') AND regexp_matches({_EXT.format('file_name')}, 'exe|^sys$')
UNION ALL SELECT id, 'FC1', 'ODD_PATH', file_name, 'path' FROM ft WHERE regexp_matches(file_path, '/brand1[0-3]/') AND regexp_matches({_STEM.format('file_name')}, 'widget$')""")
def file_rules(spark, sf):
    out = _hits(file_timeline(spark, sf), rule_set(spark), detect.file_hits)
    return out.select("id", "rule_id", "analysis_type", "tool_name", "justification")


@query("g02_process_rules", f"""{WITH_TIMELINE} SELECT id, 'rclone.exe run by ' || TargetUserName AS justification FROM tl WHERE process_name = 'rclone.exe' AND contains(command_line, '-nop') AND contains(command_line, 'hidden') AND contains(lower(process_path), 'temp')""")
def process_rules(spark, sf):
    return _hits(timeline(spark, sf), rule_set(spark), detect.file_hits).select("id", "justification")


@query("g03_powershell_tokens", f"""{WITH_TIMELINE}, h AS (SELECT id, command_line FROM tl WHERE process_name = 'powershell.exe')
SELECT id, '-encodedcommand' AS tool_name, 'LIKELY_NOTABLE' AS score FROM h WHERE contains(lower(command_line), '-encodedcommand') UNION ALL SELECT id, '-w hidden', 'UNKNOWN' FROM h WHERE contains(lower(command_line), '-w hidden')""")
def powershell_tokens(spark, sf):
    return _hits(timeline(spark, sf), rule_set(spark), detect.token_hits).select("id", "tool_name", "score")


@query("g04_event_rules", f"""{WITH_TIMELINE} SELECT id, 'LOGON' AS analysis_type, 'logon type ' || LogonType AS justification FROM tl WHERE event_identifier IN ('4624', '4625') AND channel = 'Security' AND LogonType IN ('3', '10') AND regexp_matches(TargetUserName, 'user1\\d(\\$|$)')
UNION ALL SELECT id, 'NETWORK', '' FROM tl WHERE event_identifier = '5156' AND channel LIKE '%Sysmon%'""")
def event_rules(spark, sf):
    return _hits(timeline(spark, sf), rule_set(spark), detect.event_hits).select("id", "analysis_type", "justification")


_HOST = "regexp_extract(url, '://([^/:?]*)', 1)"
_DOMAIN = f"""{WITH_PAGES}, h AS (SELECT id, domain, remote_host, remote_port, {_HOST} AS host, coalesce(domain, remote_host) AS target FROM wt),
k AS (SELECT * FROM h WHERE NOT (coalesce(regexp_matches(target, '(?i)^a\\.b\\.mega'), FALSE) OR (remote_port = '443' AND coalesce(contains(target, 'transfer'), FALSE))))"""


@query("g05_domain_rules", f"""{_DOMAIN} SELECT id, 'Mega' AS tool_name FROM k WHERE domain = 'mega.example' OR domain LIKE '%.mega.example'
UNION ALL SELECT id, 'Org' FROM k WHERE host = 'example.org' OR host LIKE '%.example.org' UNION ALL SELECT id, 'Blog' FROM k WHERE regexp_matches(host, '^blog\\.[^.]*\\.example\\.[^.]*$')
UNION ALL SELECT id, 'Transfer' FROM k WHERE remote_host = 'files.transfer.test'""")
def domain_rules(spark, sf):
    return _hits(web_timeline(spark, sf), rule_set(spark, globs=FEED), detect.domain_hits).select("id", "tool_name")


@query("g05_domain_rules_one_label", f"""{_DOMAIN} SELECT id, 'Mega' AS tool_name FROM k WHERE regexp_matches(domain, '^(.[^.]*\\.)?mega\\.example$')
UNION ALL SELECT id, 'Org' FROM k WHERE regexp_matches(host, '^(.[^.]*\\.)?example\\.org$') UNION ALL SELECT id, 'Blog' FROM k WHERE regexp_matches(host, '^blog\\.[^.]*\\.example\\.[^.]*$')
UNION ALL SELECT id, 'Transfer' FROM k WHERE remote_host = 'files.transfer.test'""")
def domain_rules_one_label(spark, sf):
    rules = rule_set(spark, globs=FEED)
    return _hits(web_timeline(spark, sf), rules, detect.domain_hits, domain_hits={"one_label": True}).select("id", "tool_name")


@query("g06_remote_management", f"""{WITH_TIMELINE}, ft AS ({WITH_FILES.removeprefix('WITH ft AS (').removesuffix(')')}) SELECT id, 'AnyDesk' AS tool_name FROM tl WHERE process_name = 'AnyDesk.exe' AND process_path LIKE 'C:\\Windows\\%'
UNION ALL SELECT id, 'RingTool' FROM ft WHERE file_name = 'cold_ring.dll'""".replace("'C:\\Windows\\%'", "'C:\\Windows\\System32%' ESCAPE '~'"))
def remote_management(spark, sf):
    rules = rule_set(spark)
    both = [_hits(df, rules, detect.remote_hits).select("id", "tool_name") for df in (timeline(spark, sf), file_timeline(spark, sf))]
    return both[0].unionByName(both[1])


@query("g07_transfer_tools", f"""{WITH_TIMELINE}, ft AS ({WITH_FILES.removeprefix('WITH ft AS (').removesuffix(')')}) SELECT id, 'Rclone' AS tool_name FROM tl WHERE process_name = 'rclone.exe' UNION ALL SELECT id, 'TarBall' FROM ft WHERE file_name = 'red_gear.tar.gz'""")
def transfer_tools(spark, sf):
    rules = rule_set(spark)
    both = [_hits(df, rules, detect.tool_hits).select("id", "tool_name") for df in (timeline(spark, sf), file_timeline(spark, sf))]
    return both[0].unionByName(both[1])


@query("g08_library_paths", f"""{WITH_FILES}, e AS (SELECT *, {_EXT.format('file_name')} AS ext FROM ft) SELECT id, 'Library ' || file_name AS justification FROM e WHERE ext IN ('dll', 'sys') AND regexp_matches(file_path, '(?i)/c/brand2./[^/]*/') AND regexp_matches({_STEM.format('file_name')}, '(?i)blue_[^/]*')
UNION ALL SELECT id, 'driver' FROM e WHERE ext = 'sys' AND contains(file_path, '/economy/')""")
def library_paths(spark, sf):
    return _hits(file_timeline(spark, sf), rule_set(spark), detect.library_hits).select("id", "justification")


@query("g09_excluded_network", f"""{WITH_PAGES} SELECT id FROM wt WHERE coalesce(regexp_matches(coalesce(domain, remote_host), '(?i)^a\\.b\\.mega'), FALSE) OR (remote_port = '443' AND coalesce(contains(coalesce(domain, remote_host), 'transfer'), FALSE))""")
def excluded_network(spark, sf):
    df = detect.with_facets(web_timeline(spark, sf))
    return df.where(detect.excluded_network(rule_set(spark))).select("id")


_PS = f"""{WITH_TIMELINE}, h AS (SELECT *, CASE WHEN process_name = 'powershell.exe' AND contains(lower(command_line), '-encodedcommand') THEN 1 END AS enc,
 CASE WHEN process_name = 'powershell.exe' AND contains(lower(command_line), '-w hidden') THEN 1 END AS hid,
 CASE WHEN event_identifier IN ('4624', '4625') AND channel = 'Security' AND LogonType IN ('3', '10') AND regexp_matches(TargetUserName, 'user1\\d(\\$|$)') THEN 1 END AS logon,
 CASE WHEN event_identifier = '5156' THEN 1 END AS net, CASE WHEN process_name = 'AnyDesk.exe' AND contains(process_path, 'System32') THEN 1 END AS rmm,
 CASE WHEN process_name = 'rclone.exe' THEN 1 END AS tool,
 CASE WHEN process_name = 'rclone.exe' AND contains(command_line, '-nop') AND contains(lower(process_path), 'temp') THEN 1 END AS exf FROM tl)"""


@query("g11_fold", f"""{_PS} SELECT id, concat_ws('; ', CASE WHEN exf = 1 THEN 'FileCorrelated: rclone.exe' END, CASE WHEN enc = 1 THEN 'PowershellArgs: -encodedcommand' END, CASE WHEN hid = 1 THEN 'PowershellArgs: -w hidden' END,
 CASE WHEN logon = 1 THEN 'EventsMatching: LOGON' END, CASE WHEN net = 1 THEN 'EventsMatching: NETWORK' END, CASE WHEN rmm = 1 THEN 'RemoteManagement: AnyDesk' END, CASE WHEN tool = 1 THEN 'ExecutableType: Rclone' END) AS rule_names,
 CASE WHEN exf = 1 OR rmm = 1 OR tool = 1 THEN 'NOTABLE' WHEN enc = 1 OR net = 1 THEN 'LIKELY_NOTABLE' ELSE 'UNKNOWN' END AS score,
 CAST(coalesce(exf,0)+coalesce(enc,0)+coalesce(hid,0)+coalesce(logon,0)+coalesce(net,0)+coalesce(rmm,0)+coalesce(tool,0) AS VARCHAR) AS n,
 CASE WHEN exf = 1 THEN 'T1048, T1567' WHEN enc = 1 THEN 'T1059' END AS mitre, CASE WHEN enc = 1 OR hid = 1 THEN 'Execution' END AS impact,
 concat_ws('|', 'cloudrules', CASE WHEN exf = 1 OR rmm = 1 OR tool = 1 THEN 'cloudrules:notable' END, CASE WHEN enc = 1 OR net = 1 THEN 'cloudrules:likely_notable' END, CASE WHEN hid = 1 OR logon = 1 THEN 'cloudrules:unknown' END) AS tags
FROM h WHERE coalesce(exf, enc, hid, logon, net, rmm, tool) = 1""")
def fold(spark, sf):
    rules = rule_set(spark)
    out = detect.fold(detect.detect(timeline(spark, sf), rules), rules).where(F.size("detections") > 0)
    a = F.col("attrs")
    return out.select(
        "id", a["cloudrules_rule"].alias("rule_names"), a["cloudrules_score"].alias("score"), a["cloudrules_detection_count"].alias("n"),
        a["mitre_attack"].alias("mitre"), a["cloudrules_impact"].alias("impact"), F.array_join("tags", "|").alias("tags"),
    )


@query("g12_current_rules", """SELECT p_brand AS rule_id, p_size AS version, p_partkey AS rule_order FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part WHERE p_partkey % 5 > 0 AND p_type <> 'SMALL') WHERE r = 1""")
def current(spark, sf):
    rules = read(spark, sf, "part").select(
        F.col("p_partkey").alias("rule_order"), F.col("p_brand").alias("rule_id"), F.col("p_size").alias("version"),
        (F.col("p_partkey") % 5 > 0).alias("enabled"), (F.col("p_type") != "SMALL").alias("has_metadata"), F.lit("x").alias("payload"),
    )
    return current_rules(rules).select("rule_id", "version", "rule_order")


@query("f13_detection_summary", f"""{_PS}, d AS (SELECT 'NOTABLE' AS score, 'FileCorrelated' AS plugin, 'EXFILTRATION_TOOL' AS kind FROM h WHERE exf = 1 UNION ALL SELECT 'LIKELY_NOTABLE', 'PowershellArgs', 'POWERSHELL_ARGS' FROM h WHERE enc = 1
 UNION ALL SELECT 'UNKNOWN', 'PowershellArgs', 'POWERSHELL_ARGS' FROM h WHERE hid = 1 UNION ALL SELECT 'UNKNOWN', 'EventsMatching', 'LOGON' FROM h WHERE logon = 1 UNION ALL SELECT 'LIKELY_NOTABLE', 'EventsMatching', 'NETWORK' FROM h WHERE net = 1
 UNION ALL SELECT 'NOTABLE', 'RemoteManagement', 'REMOTE_ACCESS_SOFTWARE' FROM h WHERE rmm = 1 UNION ALL SELECT 'NOTABLE', 'ExecutableType', 'TRANSFER_TOOL' FROM h WHERE tool = 1)
SELECT 'score' AS facet, score AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'plugin', plugin, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'type', kind, count(*) FROM d GROUP BY 2""")
def detection_summary(spark, sf):
    tagged = detect.detect(timeline(spark, sf), rule_set(spark))
    return detect.detection_summary(detect.detections(tagged, ["id"]))


# ---------------------------------------------------------------------- Sigma

def _sigma(spark, sf):
    """Detections on log records: three rules by modulus, one of them twice."""
    df = raw_events(spark, sf)
    k = F.col("k")
    rules = F.array_compact(F.array(
        F.when(k % 2 == 0, F.struct(F.lit("Even").alias("title"), F.lit("rule-1").alias("rule_id"), F.lit("low").alias("level"), F.lit("T1").alias("mitre"))),
        F.when(k % 5 == 0, F.struct(F.lit("Five").alias("title"), F.lit("rule-2").alias("rule_id"), F.lit("high").alias("level"), F.lit("T3, T2").alias("mitre"))),
        F.when(k % 7 == 0, F.struct(F.lit("Seven").alias("title"), F.lit("rule-3").alias("rule_id"), F.lit("medium").alias("level"), F.lit("").alias("mitre"))),
    ))
    channel = F.when(F.col("kind") == "signup", F.lit("System")).when(F.col("kind") == "purchase", F.lit("Microsoft-Windows-Sysmon/Operational")).otherwise(F.lit("Security"))
    return df.select(
        F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("upload_id"), channel.alias("channel"),
        F.col("id").cast("string").alias("record_number"), F.posexplode(rules).alias("seq", "r"),
    ).select("upload_id", "channel", "record_number", "seq", "r.*")


_SIGMA = f"""{WITH_TIMELINE}, s AS (SELECT id, concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'Even' END, CASE WHEN k % 5 = 0 THEN 'Five' END, CASE WHEN k % 7 = 0 THEN 'Seven' END) AS names,
 CASE WHEN k % 5 = 0 THEN 'high' WHEN k % 7 = 0 THEN 'medium' ELSE 'low' END AS level, k FROM tl WHERE k % 2 = 0 OR k % 5 = 0 OR k % 7 = 0)"""


@query("g01_sigma_tags", f"""{_SIGMA} SELECT id, names, level, concat_ws(', ', CASE WHEN k % 2 = 0 THEN 'T1' END, CASE WHEN k % 5 = 0 THEN 'T2, T3' END) AS mitre,
 concat_ws('|', 'hayabusa', 'sigma', CASE WHEN k % 2 = 0 THEN 'hayabusa:low' END, CASE WHEN k % 5 = 0 THEN 'hayabusa:high' END, CASE WHEN k % 7 = 0 THEN 'hayabusa:medium' END) AS tags FROM s""")
def sigma_tags(spark, sf):
    out = detect.tag_sigma(timeline(spark, sf), _sigma(spark, sf)).where(F.size("tags") > 0)
    a = F.col("attrs")
    return out.select(
        "id", a["hayabusa_rule"].alias("names"), a["hayabusa_level"].alias("level"), F.coalesce(a["mitre_attack"], F.lit("")).alias("mitre"),
        F.array_join("tags", "|").alias("tags"),
    )


@query("g10_sigma_exclusions", f"{_SIGMA} SELECT id, names FROM s WHERE k % 7 > 0")
def sigma_exclusions(spark, sf):
    tagged = detect.tag_sigma(timeline(spark, sf), _sigma(spark, sf))
    out = detect.drop_excluded_sigma(tagged, rule_set(spark).sigma_excluded)
    return out.where(F.size("tags") > 0).select("id", F.col("attrs")["hayabusa_rule"].alias("names"))


@query("f14_sigma_summary", f"""{WITH_EVENTS}, d AS (SELECT 'low' AS level, 'Even' AS title FROM ev WHERE k % 2 = 0 UNION ALL SELECT 'high', 'Five' FROM ev WHERE k % 5 = 0 UNION ALL SELECT 'medium', 'Seven' FROM ev WHERE k % 7 = 0)
SELECT 'level' AS facet, level AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'rule', title, count(*) FROM d GROUP BY 2""")
def sigma_summary(spark, sf):
    return detect.sigma_summary(_sigma(spark, sf))


# ---------------------------------------------------------------- correlation

def _mails(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("datetime"), (F.col("o_orderkey") % 4000).alias("message_id"),
        F.col("o_orderpriority").alias("sender"), F.col("o_orderstatus").alias("subject"),
    )


@query("g14_clicks_with_mail", """WITH m AS (SELECT o_orderkey % 4000 AS message_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS mail_id, count(*) AS mail_count FROM orders GROUP BY 1)
SELECT l_orderkey * 10 + l_linenumber AS click_id, l_partkey, message_id, mail_id, mail_count FROM lineitem JOIN m ON message_id = l_orderkey % 7000""")
def clicks_with_mail(spark, sf):
    clicks = read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("timestamp").alias("datetime"),
        (F.col("l_orderkey") % 7000).alias("message_id"), F.col("l_partkey").cast("string").alias("url"),
    )
    out = correlate.clicks_with_mail(_mails(spark, sf), clicks)
    return out.select("click_id", F.col("url").cast("long").alias("l_partkey"), "message_id", "mail_id", "mail_count")


def _sides(spark, sf):
    df = raw_events(spark, sf).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), "id", F.unix_micros("ts").alias("micros"), "kind")
    return df.where(F.col("kind") == "click").drop("kind"), df.where(F.col("kind") == "view").drop("kind")


_HOUR = "3600000000"
_CV = f"""{WITH_EVENTS}, c AS (SELECT user_id, id, epoch_us(ts) AS t FROM ev WHERE kind = 'click'), v AS (SELECT user_id, id, epoch_us(ts) AS t FROM ev WHERE kind = 'view')"""


@query("g15_signins_after_click", f"""{_CV} SELECT v.id, v.t AS micros, max(c.t) AS match_micros FROM v JOIN c ON v.user_id = c.user_id AND c.t <= v.t AND c.t >= v.t - {_HOUR} GROUP BY 1, 2""")
def signins_after_click(spark, sf):
    clicks, signins = _sides(spark, sf)
    return correlate.signins_after_click(clicks, signins).select("id", "micros", "match_micros")


@query("g15_clicks_before_signin", f"""{_CV} SELECT c.id, c.t AS micros, min(v.t) AS match_micros FROM v JOIN c ON v.user_id = c.user_id AND c.t <= v.t AND c.t >= v.t - {_HOUR} GROUP BY 1, 2""")
def clicks_before_signin(spark, sf):
    clicks, signins = _sides(spark, sf)
    return correlate.clicks_before_signin(clicks, signins).select("id", "micros", "match_micros")


@query("g15_latest_before_one_key", f"""{_CV} SELECT v.id, v.t AS micros, c.t AS match_micros FROM (SELECT *, 1 AS g FROM v) v ASOF JOIN (SELECT DISTINCT t, 1 AS g FROM c) c ON v.g = c.g AND v.t >= c.t WHERE c.t >= v.t - {_HOUR}""")
def latest_before_one_key(spark, sf):
    """The same link with one key for all rows: only the chunks spread it."""
    clicks, signins = (d.withColumn("user", F.lit("all")) for d in _sides(spark, sf))
    return correlate.latest_before(signins, clicks, ["user"]).select("id", "micros", "match_micros")


@query("g16_hash_across_sources", f"""{WITH_FILES}, a AS (SELECT md5(p_name) AS hash, min(p_partkey) AS first_mail, count(DISTINCT p_partkey) AS mail_count FROM part GROUP BY 1)
SELECT id AS file_id, hash, first_mail, mail_count FROM ft JOIN a ON md5 = hash""")
def hash_across_sources(spark, sf):
    part = read(spark, sf, "part")
    attachments = part.select(F.upper(F.md5("p_name")).alias("sha256"), F.col("p_partkey").alias("mail_id"))
    endpoint = file_timeline(spark, sf).select("id", F.col("attrs")["md5"].alias("sha256"))
    return correlate.files_with_attachment(attachments, endpoint)


_ID_SQL = f"""{WITH_TIMELINE}, x AS (SELECT id, lower(TargetUserName) AS value, 'TargetUserName' AS field FROM tl UNION ALL SELECT id, lower(host_name), 'host_name' FROM tl WHERE host_name <> ''
 UNION ALL SELECT id, IpAddress, 'IpAddress' FROM tl WHERE IpAddress <> '-')"""


def _identities(df):
    a = F.col("attrs")
    return correlate.identity_values(df, [a["TargetUserName"], F.col("host_name"), a["IpAddress"]], ["TargetUserName", "host_name", "IpAddress"])


@query("g17_identity_activity", f"""{_ID_SQL} SELECT value, count(*) AS mentions, string_agg(DISTINCT field, ', ' ORDER BY field) AS fields FROM x WHERE value IS NOT NULL GROUP BY 1""")
def identity_activity(spark, sf):
    return correlate.identity_activity(_identities(timeline(spark, sf)))


@query("g17_events_of_identities", f"""{_ID_SQL} SELECT DISTINCT id FROM x WHERE value IN (SELECT 'user' || c_custkey FROM customer WHERE c_custkey < 20) OR value IN (SELECT '10.0.0.' || c_custkey FROM customer WHERE c_custkey < 20)""")
def events_of_identities(spark, sf):
    df = timeline(spark, sf)
    keys = read(spark, sf, "customer").where("c_custkey < 20").select(F.col("c_custkey").cast("string").alias("k"))
    wanted = keys.select(F.concat(F.lit("USER"), "k").alias("value")).unionByName(keys.select(F.concat(F.lit("10.0.0."), "k").alias("value")))
    return correlate.events_of_identities(df, _identities(df), wanted).select("id")
