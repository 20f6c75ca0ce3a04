"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import files, records as recs
from siftline.operators.build import BUILDERS, emit
from siftline.operators.detect import detect, fold
from siftline.operators.filters import by_artifact
from siftline.plans.detection_queries import RULES
from siftline.sources import records as src
from siftline.sources import rules as rule_src
from siftline.sources import timeline as tl


@pytest.fixture
def capture(tmp_path):
    root = tmp_path / "cap1"
    (root / "live").mkdir(parents=True)
    (root / "artifacts" / "Tasks").mkdir(parents=True)
    (root / "manifest.json").write_text(json.dumps({
        "collector_version": "1", "platform": " Linux ", "hostname": "", "os_version": "x", "domain": "d",
        "collection_timestamp": "2024-02-01T10:00:00+02:00", "collection_duration_seconds": 1.5,
    }))
    return root


def test_timeline_round_trip(spark, tmp_path):
    text = "\n".join([
        json.dumps({"datetime": "2024-01-01T00:00:00.123Z", "message": "a", "event_type": "t", "host_name": "h", "IpAddress": "1.1.1.1", "n": 5}),
        "", "{bad", json.dumps({"datetime": "never", "message": "b"}), "[1]",
        '{"datetime":"2024-01-02T00:00:00Z","message":"c\\u0000d","is_suspicious":"TRUE","host_name":""}',
    ])
    src_file = tmp_path / "in.jsonl"
    src_file.write_text(text)
    events, rejects = tl.read_timeline(spark, str(src_file), "s1", "u1")
    rows = {r["message"]: r for r in events.collect()}
    assert set(rows) == {"a", "cd"}
    assert rows["a"]["attrs"]["n"] == "5" and rows["a"]["is_suspicious"] is False
    assert rows["cd"]["is_suspicious"] is True and rows["cd"]["host_name"] is None and rows["cd"]["event_type"] == "unknown"
    assert sorted(r["reason"] for r in rejects.collect()) == ["not a JSON object", "not a JSON object", "unreadable datetime"]
    assert tl.count_lines(spark, str(src_file)) == 5
    out = tmp_path / "out"
    tl.write_timeline(events, str(out))
    again, none = tl.read_timeline(spark, str(out), "s1", "u1")
    assert sorted(r["message"] for r in again.collect()) == ["a", "cd"] and none.count() == 0


def test_attribute_does_not_replace_base_field(spark):
    df = spark.createDataFrame([("shown", {"message": "full text", "k": "v", "event_type": "t"})], "message string, attrs map<string,string>")
    for c, v in {"timestamp_desc": "d", "event_type": "t", "data_type": None, "source_short": None, "source_long": None,
                 "host_name": None, "ct_significance": None}.items():
        df = df.withColumn(c, F.lit(v).cast("string"))
    df = df.withColumn("is_suspicious", F.lit(False)).withColumn("datetime", F.lit("2024-01-01").cast("timestamp"))
    body = json.loads(tl.event_json(df).first()["value"])
    assert body["message"] == "shown" and body["data.message"] == "full text" and body["k"] == "v" and "data.event_type" not in body


def _events(spark, upload, n):
    return spark.range(n).select(
        F.lit(upload).alias("upload_id"), F.lit("s1").alias("site_id"), F.lit("h").alias("host_name"), F.col("id").alias("seq"),
        F.lit("2024-01-01").cast("timestamp").alias("datetime"), F.lit("d").alias("timestamp_desc"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit("t").alias("event_type"), F.lit("x").alias("data_type"),
        F.lit("s").alias("source_short"), F.lit("l").alias("source_long"), F.lit(None).cast("string").alias("ct_significance"),
        F.lit(False).alias("is_suspicious"), F.create_map(F.lit("channel"), F.lit("Security")).alias("attrs"),
    )


def test_event_table_replaces_a_capture_that_is_loaded_again(spark, tmp_path):
    path = str(tmp_path / "events")
    tl.save_events(_events(spark, "u1", 3).unionByName(_events(spark, "u2", 4)), path)
    tl.save_events(_events(spark, "u1", 5), path)
    counts = {r["upload_id"]: r["count"] for r in tl.load_events(spark, path).groupBy("upload_id").count().collect()}
    assert counts == {"u1": 5, "u2": 4}
    assert "channel" in tl.load_events(spark, path).columns
    plan = tl.load_events(spark, path).where("upload_id = 'u2' AND channel = 'Security'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(channel), EqualTo(channel,Security)]" in plan


def test_stored_results_are_replaced_per_capture(spark, tmp_path):
    path = str(tmp_path / "tools")
    tl.save_results(spark.createDataFrame([("u1", "a"), ("u2", "b")], "upload_id string, tool_name string"), path)
    tl.save_results(spark.createDataFrame([("u1", "c")], "upload_id string, tool_name string"), path)
    assert sorted((r["upload_id"], r["tool_name"]) for r in spark.read.parquet(path).collect()) == [("u1", "c"), ("u2", "b")]


def test_manifest_and_live(spark, capture):
    (capture / "live" / "dns_cache.json").write_text(json.dumps([{"name": "a.b", "data": "1.1.1.1", "ttl": 5}, {"name": ""}]))
    (capture / "live" / "other.json").write_text("[]")
    manifests = src.read_manifests(spark, str(capture / "manifest.json"), "s1")
    m = manifests.first()
    assert (m["upload_id"], m["host_name"], m["platform"]) == ("cap1", "unknown", "linux")
    assert str(m["collection_ts"]) == "2024-02-01 10:00:00"
    live = src.with_captures(src.read_live(spark, [str(capture / "live" / "dns_cache.json"), str(capture / "live" / "other.json")]), manifests)
    out = BUILDERS["live.dns_cache"](live.where("kind = 'dns_cache'")).collect()
    assert [r["message"] for r in out] == ["DNS Cache: a.b -> 1.1.1.1"] and out[0]["attrs"]["ttl"] == "5"


def test_listing_and_sections(spark, capture):
    (capture / "live" / "filesystem.jsonl").write_text('{"path":"/a","name":"a","is_directory":true,"modified":"2024-01-01T00:00:00Z"}\nnot json\n')
    (capture / "sections").mkdir()
    (capture / "sections" / "x.jsonl").write_text(
        json.dumps({"file": {"fullPath": "/f", "dateModified": 1704067200000, "md5hash": "x"}}) + "\n"
        + json.dumps({"process": {"startTime": "1704067200000", "name": "p.exe", "userID": "bob", "userDomain": "D"}}) + "\n"
        + json.dumps({"collectionInfo": {"x": 1}}) + "\n"
    )
    manifests = src.read_manifests(spark, str(capture / "manifest.json"), "s1")
    listing = files.file_listing(src.with_captures(src.read_fs_listing(spark, str(capture / "live" / "filesystem.jsonl")), manifests))
    assert [r["message"] for r in listing.collect()] == ["Directory: /a"]
    parts = src.read_sections(spark, str(capture / "sections" / "x.jsonl"))
    assert len(parts) == 14
    built = [BUILDERS[k](src.with_captures(parts[k], manifests)) for k in ("section.file", "section.process")]
    assert [r["message"] for r in built[0].collect()] == ["File (hashed): /f"]
    assert [r["message"] for r in built[1].collect()] == ["Program executed: p.exe (User: D\\bob)"]


def test_dhcp_mail_cloud(spark, capture):
    art = capture / "artifacts"
    (art / "DhcpSrvLog-Mon.log").write_text(
        "ID,Date,Time,Description,IP,Host,MAC\n# note\n10,2024-01-02,03:04:05,Assign,10.0.0.5,\"pc,1\",AABBCCDDEEFF\n99,2024-01-02,03:04:06,x,10.0.0.6\n11,2024-01-02\n"
    )
    (art / "clicks.csv").write_text('ClickTime,Url,NetworkMessageId,ClickAction\n2024-01-01T00:00:00Z,"http://x/,y",id1,Blocked\n,u,id2,\n')
    (art / "signins.json").write_text(json.dumps([{
        "createdDateTime": "2024-01-01T00:00:00Z", "userPrincipalName": "a@b", "appDisplayName": "App", "ipAddress": "9.9.9.9",
        "location": {"city": "X", "geo": {"lat": 1}},
    }]))
    (art / "audit.json").write_text('{"activityDateTime":"2024-01-01T00:00:00Z","activityDisplayName":"Add","userPrincipalName":"a@b"}\n{"userPrincipalName":"no time"}\n')
    manifests = src.read_manifests(spark, str(capture / "manifest.json"), "s1")
    dhcp = recs.dhcp(src.with_captures(src.read_dhcp(spark, str(art / "DhcpSrvLog-Mon.log")), manifests)).collect()
    assert sorted(r["message"] for r in dhcp) == ["DHCP: DHCP Event 99 - 10.0.0.6", "DHCP: New Lease - 10.0.0.5 (pc,1)"]
    assert {r["attrs"].get("mac_address") for r in dhcp} == {"AA:BB:CC:DD:EE:FF", None}
    mail = recs.mail(src.with_captures(src.read_mail(spark, str(art / "clicks.csv")), manifests)).collect()
    assert [(r["message"], r["event_type"]) for r in mail] == [("MDO URL Click: http://x/,y [Blocked]", "mdo_url_click")]
    cloud = recs.cloud(src.with_captures(src.read_cloud(spark, [str(art / "signins.json"), str(art / "audit.json")]), manifests)).collect()
    by = {r["event_type"]: r for r in cloud}
    assert set(by) == {"entra_signin", "entra_audit"}
    assert by["entra_signin"]["message"] == "Entra: a@b -> App from 9.9.9.9" and by["entra_signin"]["attrs"]["location_city"] == "X"


def test_tasks(spark, capture):
    xml = (
        "<Task><RegistrationInfo><Date>2024-01-01T00:00:00</Date><Author>me</Author></RegistrationInfo><Actions><Exec><Command>a.exe</Command>"
        "<Arguments>-x</Arguments></Exec></Actions><Principals><Principal><UserId>SYSTEM</UserId></Principal></Principals></Task>"
    )
    (capture / "artifacts" / "Tasks" / "job.xml").write_text(xml)
    (capture / "artifacts" / "Tasks" / "broken.xml").write_text("<Task><Reg")
    manifests = src.read_manifests(spark, str(capture / "manifest.json"), "s1")
    rows = recs.task_definitions(src.with_captures(src.read_tasks(spark, str(capture / "artifacts" / "Tasks" / "*.xml")), manifests)).collect()
    assert [(r["message"], r["attrs"]["user_id"]) for r in rows] == [("Scheduled Task: job -> a.exe -x", "SYSTEM")]


def test_dash_table(spark, capture):
    table = "Name        Version  Vendor  Acceptance Level  Install Date\n----------  -------  ------  ----------------  ------------\nnet driver  1.0      V       Certified         2024-01-15\ntool        2.0      W       Community\n\n"
    (capture / "live" / "software_vib_list.txt").write_text(table)
    manifests = src.read_manifests(spark, str(capture / "manifest.json"), "s1")
    rows = BUILDERS["esxi.packages"](src.with_captures(src.read_dash_tables(spark, str(capture / "live" / "software_vib_list.txt")), manifests)).collect()
    assert {(r["message"], r["timestamp_desc"], str(r["datetime"])) for r in rows} == {
        ("VIB: net driver v1.0 [V, Certified]", "Program Install Date", "2024-01-15 00:00:00"),
        ("VIB: tool v2.0 [W, Community]", "Collection Time (Program Installed)", "2024-02-01 10:00:00"),
    }


def test_docker_journal_unified_log_packages(spark, capture):
    live = capture / "live"
    (live / "docker_ps.json").write_text(json.dumps({"ID": "0123456789abcdef", "Names": "web", "State": "running"}) + "\n" + json.dumps({"Names": "x"}) + "\n")
    (live / "docker_info.json").write_text(json.dumps({"ServerVersion": "25", "Containers": 2, "Images": 3, "Driver": "overlay2"}))
    (live / "journal_sshd.jsonl").write_text(json.dumps({"MESSAGE": "Failed password for x", "__REALTIME_TIMESTAMP": "1704067200123456", "_PID": "7"}) + "\n")
    (live / "ul.ndjson").write_text(json.dumps({"Timestamp": "2024-01-01 00:00:00.5", "eventMessage": "hi", "processImagePath": "/p", "logType": "Info"}) + "\n")
    (live / "packages.json").write_text(json.dumps({"managers": [
        {"manager": "dpkg", "raw": "bash\t5\tamd64\tinstall ok installed\nold\t1\tamd64\tdeinstall ok config-files"},
        {"manager": "snap", "raw": "Name Version Rev\ncore 16 1"}, {"manager": "apk", "raw": "musl 1.2"},
    ]}))
    m = src.read_manifests(spark, str(capture / "manifest.json"), "s1")

    def built(kind, df):
        return sorted((r["message"], r["event_type"]) for r in BUILDERS[kind](src.with_captures(df, m)).collect())

    assert built("linux.docker_containers", src.read_docker(spark, str(live / "docker_ps.json"), "containers")) == [("Docker container: web (0123456789ab) - running", "docker_container")]
    assert built("linux.docker_info", src.read_docker(spark, str(live / "docker_info.json"), "info")) == [("Docker version 25: 2 containers, 3 images, driver=overlay2", "os_config")]
    assert built("linux.sshd_journal", src.read_sshd_journal(spark, str(live / "journal_sshd.jsonl"))) == [("sshd[7]: Failed password for x", "logon_failed")]
    assert built("macos.unified_log", src.read_unified_log(spark, str(live / "ul.ndjson"))) == [("[] /p: hi", "os_log")]
    assert [x for x, _ in built("linux.packages", src.read_packages(spark, str(live / "packages.json")))] == [
        "Installed Package (apk): musl 1.2", "Installed Package (dpkg): bash v5 [amd64]", "Installed Package (snap): core v16",
    ]


def test_catalog(spark, capture):
    (capture / "artifacts" / "Tasks" / "A.XML").write_text("x")
    cat = src.catalog(spark, str(capture / "artifacts"))
    rows = by_artifact(cat, r"\.xml$", "tasks").collect()
    assert [(r["file_name"], r["path"], r["size"]) for r in rows] == [("A.XML", "Tasks\\A.XML", 1)]


def test_rule_file(spark, tmp_path):
    def rule(rid, version, body, plugin="PowershellArgsCloudRulePlugin_v1", enabled=True, meta=True):
        out = {"ruleId": rid, "ruleVersion": version, "plugin": plugin, "enabled": enabled}
        return out | ({"ruleMetadata": {"type": "t", "payload": body}} if meta else {})

    old = {"rules": [rule("X", 1, {"rules": []})]}
    new = {"rules": [
        rule("A", 1, {"rules": [{"argToken": "old", "result": {}}]}), rule("A", 2, {"rules": [{"argToken": "NEW", "result": {"score": "NOTABLE"}}]}),
        rule("B", 1, {"rules": [{"argToken": "off", "result": {}}]}, enabled=False), rule("C", 1, None, meta=False),
        rule("D", 1, {"rules": [{"matches": {"fileName": "([", "path": "ok"}, "result": {}}, {"matches": {"path": "fine"}, "result": {}}]}, "FileCorrelatedCloudRulePlugin_v1"),
        rule("E", 1, "no JSON"), rule("F", 1, {"commonBitsJobDomains": [{"host": "a("}, {"host": "b"}]}, "CommonBitsJobDomainCloudRulePlugin_v1"),
    ]}
    (tmp_path / "CloudRules_rv001.json").write_text(json.dumps(old))
    with gzip.open(tmp_path / "CloudRules_rv002.json.gz", "wt") as fh:
        json.dump(new, fh)
    rules = rule_src.prepare_rules(spark, rule_src.read_rules(spark, str(tmp_path)))
    assert [t["token"] for t in rules.tokens] == ["new"]
    # A rule with a bad pattern is left out, and told; it does not match more.
    assert [r["path"] for r in rules.files] == ["(?i)fine"] and rules.common_domains == ["(?i)b"]
    assert rules.dropped == [("D", "bad pattern (["), ("E", "payload is no JSON"), ("F", "bad pattern a(")]


def test_sigma_file(spark, capture):
    (capture / "live" / "sigma.jsonl").write_text("\n".join(json.dumps(x) for x in [
        {"Channel": "Sec", "RecordID": 5, "RuleTitle": "T", "RuleID": "r", "Level": "HIGH", "MitreAttack": ["T1", "", "T2"]},
        {"Channel": "X", "EvtxRecordId": "6", "RuleTitle": "U", "Level": "low", "Tags": ["attack.t3", "other"]},
        {"Channel": "Sec", "RuleTitle": "no record"},
    ]))
    rows = {r["record_number"]: r for r in src.read_sigma(spark, str(capture / "live" / "sigma.jsonl")).collect()}
    assert set(rows) == {"5", "6"}
    assert (rows["5"]["channel"], rows["5"]["level"], rows["5"]["mitre"]) == ("Security", "high", "T1, T2")
    assert rows["6"]["mitre"] == "attack.t3"


def test_report_is_sorted_with_a_heading(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "file_path string, n int")
    src.write_report(df, str(tmp_path / "r"), ["file_path"])
    text = "".join(sorted(p.read_text() for p in (tmp_path / "r").glob("part-*")))
    assert text.splitlines()[0] == "file_path,n"
    assert [r["file_path"] for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_whole_pipeline_is_idempotent(spark):
    df = _events(spark, "u1", 50)
    once = emit(df.unionByName(df))
    twice = emit(once)
    assert once.count() == 50 and twice.drop("attrs").exceptAll(once.drop("attrs")).count() == 0


def test_rules_order_does_not_matter_for_the_set_of_hits(spark):
    from siftline.plans.detection_queries import rule_set

    rules = rule_set(spark)
    df = _events(spark, "u1", 3).withColumn("attrs", F.create_map(
        F.lit("process_name"), F.lit("powershell.exe"), F.lit("command_line"), F.lit("x -EncodedCommand -W HIDDEN")
    ))
    hits = {tuple(sorted(h["tool_name"] for h in r["detections"])) for r in detect(df, rules).collect()}
    rules.tokens.reverse()
    again = {tuple(sorted(h["tool_name"] for h in r["detections"])) for r in detect(df, rules).collect()}
    assert hits == again == {("-encodedcommand", "-w hidden")}
    row = fold(detect(df, rules), rules).first()
    assert row["tags"][0] == "cloudrules" and row["attrs"]["cloudrules_detection_count"] == "2"
    assert len(RULES) == 12


# ------------------------------------------------------------- files as they are

def test_odd_bytes_are_replaced_and_told(spark, tmp_path):
    from siftline.sources import texts

    art = tmp_path / "cap1" / "artifacts"
    art.mkdir(parents=True)
    (art / "latin.txt").write_bytes("caf\xe9 one\ntwo\n".encode("latin-1"))
    (art / "good.txt").write_bytes("﻿café\r\nx".encode())
    (art / "wide.txt").write_bytes("é1\ncut".encode("utf-16") + b"\x00")
    (art / "big.txt").write_bytes(b"\xfe\xff" + "é2".encode("utf-16-be"))
    rows = {r["rel"]: r for r in texts.read_texts(spark, str(art)).collect()}
    assert {k: (r["encoding"], r["text"]) for k, r in rows.items()} == {
        "latin.txt": ("replaced", "caf� one\ntwo\n"), "good.txt": ("utf-8", "café\r\nx"), "wide.txt": ("utf-16", "é1\ncut"), "big.txt": ("utf-16", "é2")}
    assert [r["file"].rsplit("/", 1)[1] for r in texts.text_problems(texts.read_texts(spark, str(art))).collect()] == ["latin.txt"]
    lines = texts.read_lines(spark, [str(art / "latin.txt"), str(art / "good.txt")]).orderBy("rel", "line_no").collect()
    assert [(r["rel"], r["line_no"], r["line"]) for r in lines] == [("good.txt", 1, "café"), ("good.txt", 2, "x"), ("latin.txt", 1, "caf� one"), ("latin.txt", 2, "two")]
    wide = texts.read_lines(spark, str(art / "wide.txt"), encoding="UTF-16LE").orderBy("line_no").collect()
    assert [r["line"] for r in wide][:1] == ["é1"]


def test_line_numbers_of_files_that_are_cut(spark, tmp_path):
    from siftline.sources import texts

    folder = tmp_path / "cap1" / "live"
    folder.mkdir(parents=True)
    for name, n in (("a.txt", 900), ("b.txt", 1), ("c.txt", 400)):
        (folder / name).write_text("".join(f"{name} {i}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = texts.read_lines(spark, str(folder))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 1301 and len({(r["file"], r["line_no"]) for r in rows}) == 1301
    assert all(r["line"] == (f"{r['rel']} {r['line_no']}" if r["line_no"] % 7 else "") for r in rows)


def test_mail_exports_with_headings_of_their_own(spark, capture):
    art = capture / "artifacts"
    (art / "clicks.csv").write_text('ClickTime, Url ,ClickAction\n2024-01-01T00:00:00Z,http://a/,"Allowed, then"\n2024-01-02T00:00:00Z,"http://b/\nc ""q""",x\n')
    (art / "mails.csv").write_text("NetworkMessageId,Timestamp,Subject,SenderAddress\nm1,2024-01-03T00:00:00Z,Hi,me@x\n")
    rows = [r["rec"] for r in src.read_mail(spark, str(art / "*.csv")).collect()]
    assert sorted(rows, key=lambda r: sorted(r.items())) == sorted([
        {"ClickTime": "2024-01-01T00:00:00Z", "Url": "http://a/", "ClickAction": "Allowed, then"},
        {"ClickTime": "2024-01-02T00:00:00Z", "Url": 'http://b/\nc "q"', "ClickAction": "x"},
        {"NetworkMessageId": "m1", "Timestamp": "2024-01-03T00:00:00Z", "Subject": "Hi", "SenderAddress": "me@x"}], key=lambda r: sorted(r.items()))


def test_a_task_in_utf16(spark, capture):
    xml = '<?xml version="1.0" encoding="UTF-16"?><Task><RegistrationInfo><Date>2024-01-01T00:00:00Z</Date><Author>Jörg</Author><URI>\\T</URI></RegistrationInfo></Task>'
    (capture / "artifacts" / "Tasks" / "T.xml").write_bytes(xml.encode("utf-16"))
    (capture / "artifacts" / "Tasks" / "bad.xml").write_bytes(b"\xff\xfe\x00<")
    rows = [r["rec"] for r in src.read_tasks(spark, str(capture / "artifacts" / "Tasks")).collect()]
    assert {(r["author"], r["uri"]) for r in rows} == {("Jörg", "\\T"), ("", "")}


def test_dash_tables_line_by_line(spark, capture):
    from siftline.operators.lines import dash_table
    from siftline.sources import texts

    body = "note\n\nName   Size  Last cell\n-----  ----  ---------\na      1     x y z\n\nbéc    22\n-----  ----\nc      3\n"
    for n, text in enumerate((body, "no table\n", "----\nx\n", "H\n---\nv\n")):
        (capture / "live" / f"t{n}.txt").write_text(text)
    paths = [str(capture / "live" / f"t{n}.txt") for n in range(4)]
    new = {(r["file"][-6:], r["row_no"], tuple(sorted(r["rec"].items()))) for r in src.read_dash_tables(spark, paths).collect()}
    old = {(r["file"][-6:], r["row_no"], tuple(sorted(r["rec"].items()))) for r in dash_table(texts.read_texts(spark, paths)).collect()}
    assert new == old and len(new) == 3
