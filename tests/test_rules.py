"""Rules as data: literals, gates, look-ups, and plans that do not grow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.operators import detect
from siftline.operators.rule_index import CROWDED, Index, any_word, combined, literal_of
from siftline.plans import mapping
from siftline.plans.detection_queries import bulk_rules, rule_set
from siftline.sources.rules import RuleSet

SF = "/root/testdata/sf0.001"
ATOMS = ["a", "b", "C", r"\.", "[ab]", "(ab|c)", "d?", "e*", "f+", "g{2}", ".", r"\d", "(?:x|yz)", "[^a]", r"\bq"]


def test_literals_are_in_every_match():
    rnd = random.Random(1)
    for _ in range(5000):
        pattern = "".join(rnd.choices(ATOMS, k=rnd.randrange(1, 7)))
        literal = literal_of("(?i)" + pattern)
        for _ in range(5):
            text = "".join(rnd.choices("abcdefgxyzq.1 ", k=9))
            if re.search("(?i)" + pattern, text):
                assert literal in text.lower(), (pattern, literal, text)
    assert literal_of(r"(?i)^(cold|red)_ring\.(?!zip)") == "_ring." and literal_of("(?i)a|bcd") == "" and literal_of(r"\Qa.b\E") == ""


def test_gates_let_every_match_through():
    rnd = random.Random(2)
    for _ in range(300):
        patterns = ["(?i)" + "".join(rnd.choices(ATOMS, k=rnd.randrange(1, 8))) for _ in range(6)]
        # Python takes inline flags only at the start; Java also in a group.
        gate = combined(patterns).replace("(?:(?i)", "(?i:")
        for _ in range(10):
            text = "".join(rnd.choices("abcdefgxyzq.1 ", k=12))
            if any(re.search(p, text) for p in patterns):
                assert re.search(gate, text), (patterns, gate, text)
    words = ["bulk1", "bulk12", "bulk2", "mass", "m.s"]
    assert all(re.search(any_word(words), w) for w in words) and not re.search(any_word(words), "bulk3 mas mxs")
    assert re.search(combined([r"(a)\1"]), "anything") is not None


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "windows_logon", {"event_identifier": "7", "User": "bulk3", "channel": "Security"}), (2, "windows_logon", {"event_identifier": "7", "User": "other"}),
        (3, "x", {"file_name": "bulk4.exe", "file_path": "C:\\bulk4\\bulk4.exe"}), (4, "web_visit", {"domain": "A.feed7.invalid"}),
        (5, "web_visit", {"domain": "feed7.invalid", "remote_port": "99"}), (6, "web_visit", {"remote_host": "cdn1.feed0.invalid"}), (7, "y", {}),
        (8, "web_visit", {"domain": "a.b.feed7.invalid"}), (9, "z", {"process_name": "PowerShell.exe", "command_line": "x -BULK5 y"}),
        (10, "x", {"file_name": "x.dll", "file_path": "C:\\bulk4\\x.dll"}),
    ]
    df = spark.createDataFrame(rows, "id long, event_type string, attrs map<string,string>")
    return df.select("*", *[F.lit("").alias(c) for c in ("message", "host_name", "data_type", "source_short", "source_long")])


def hits(events, rules, *plugins, **options):
    out = detect.detections(detect.detect(events, rules, plugins or detect.PLUGINS, **options), ["id"])
    return sorted((r["id"], r["rule_id"], r["tool_name"]) for r in out.collect())


def made(spark, rules):
    import json

    from siftline.sources.rules import prepare_rules
    rows = [(i, rid, 1, plugin, True, json.dumps(body), True) for i, (rid, plugin, body) in enumerate(rules)]
    return prepare_rules(spark, spark.createDataFrame(
        rows, "rule_order int, rule_id string, version int, plugin string, enabled boolean, payload string, has_metadata boolean"))


def test_keys_with_many_rules_are_gated(spark, events):
    def rules(n):
        return made(spark, [("E", "EventsMatchingCloudRulePlugin_v1", {"rules": [
            {"matches": {"eventIds": [7], "payload": {"User": f"^bulk{i}$"}}, "result": {"analysisResultType": "T", "score": str(i)}} for i in range(n)]})])
    for n in (5, CROWDED + 20):
        out = detect.detections(detect.detect(events, rules(n)), ["id"]).collect()
        assert [(r["id"], r["score"]) for r in out] == [(1, "3")]


def test_bulk_of_rules(spark, events):
    rules = made(spark, bulk_rules(9, 100))
    assert hits(events, rules) == [
        (3, "BULK3", "Bulk4"), (3, "BULK4", "Bulk4"),
        (4, "BULK6", "Feed"), (5, "BULK6", "Feed"), (6, "BULK6", "Feed"), (8, "BULK6", "Feed"), (9, "BULK1", "-bulk5"), (10, "BULK5", "")]
    # At most one label before the name.
    assert [i for i, *_ in hits(events, rules, detect.domain_hits, domain_hits={"one_label": True})] == [4, 5, 6]
    rules.host_ports = [("(?i)^feed7", 99)]
    assert [i for i, *_ in hits(events, rules, detect.domain_hits)] == [4, 6, 8]
    rules.common_domains = [r"(?i)\.feed7"]
    assert [i for i, *_ in hits(events, rules, detect.domain_hits)] == [6]


def test_plans_do_not_grow_with_the_rules(spark):
    df = mapping.timeline(spark, SF)

    def nodes(rules):
        plan = detect.detect(df, rules)._jdf.queryExecution().analyzed()
        return sum(plan.toString().count(f"{word}(") for word in ("transform", "lambdafunction", "RLIKE", "isin", "get", "CASE"))
    small, large = rule_set(spark, 5, 100), rule_set(spark, 60, 10_000)
    assert sum(map(len, (large.files, large.tokens, large.events, large.remote, large.tools, large.libraries))) >= 372
    assert nodes(small) == nodes(large)


def test_no_rules(spark, events):
    assert hits(events, RuleSet()) == [] and detect.detect(events, RuleSet()).columns == [*events.columns, "detections"]


def test_a_rule_set_that_is_too_large_is_refused(monkeypatch):
    monkeypatch.setattr("siftline.operators.rule_index.MOST_CHARS", 100)
    index = Index(["a"])
    index.entry(index.rule({"rule_id": "x" * 200}, "P"), [], keys=["k"])
    with pytest.raises(ValueError, match="too large"):
        index.part("rules")
