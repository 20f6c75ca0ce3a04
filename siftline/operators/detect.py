"""Detection rules over events.

Rules are data (`rule_index`): an event looks its keys up, patterns without a literal
key are gated by one combined pattern per field, and only the entries found that way
are tested. An event's detections are collected and folded in its own row; nothing is
shuffled or joined however many events there are, and the plan does not grow with the
rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.labels import literal_map
from siftline.functions.patterns import anywhere, domain_glob, fill_template
from siftline.functions.text import extension, forward_slashes, join_capped, url_host, without_extension
from siftline.functions.values import LEVEL_RANK, SCORE_RANK, any_of, highest, once, overlay, real_number, whole_number
from siftline.operators.filters import attr
from siftline.operators.rule_index import NO_ENTRIES, Index
from siftline.sources.rules import RuleSet

HIT = (
    "struct<rule_id:string,plugin:string,analysis_type:string,score:string,justification:string,"
    "mitre:array<string>,tool_name:string>"
)
NO_HITS = f"cast(array() as array<{HIT}>)"

# What the remote-management plugin reports, library extensions.
REMOTE_TYPE, REMOTE_SCORE = "REMOTE_ACCESS_SOFTWARE", "NOTABLE"
LIBRARY_TYPE, LIBRARY_EXTENSIONS = "DLL_INJECTION", ["dll", "sys", "drv"]
POWERSHELL = "powershell"

#: What tests look at, in the order in which the index numbers it.
FACETS = [
    "process", "own_name", "process_stem", "own_stem", "process_path", "own_path", "ext", "command", "parent", "task", "signed", "source",
    "command_low", "process_low", "channel", "log_name", "log_file", "domain", "remote_host", "url_host", "remote_domain", "remote_host_name",
    "name_low", "stem_low", "process_stem_low", "path", "process_path_low", "name_ext", "library_ext", "target",
]
#: Criteria of a file rule, the first one set being its gate: facets they look at.
FILE_CRITERIA = {
    "name": ["process", "own_name"], "stem": ["process_stem", "own_stem"], "path": ["process_path", "own_path"],
    "extensions": ["ext"], "arguments": ["command"], "parent": ["parent"], "task": ["task"],
}


def with_facets(df: DataFrame) -> DataFrame:
    """Add what the rules look at as `_f_*` columns, each evaluated once per
    event; empty text counts as missing."""
    def a(name: str) -> Column:
        return F.when(attr(df, name) != "", attr(df, name))

    raw = {
        "process": a("process_name"), "own_name": a("file_name"), "command": a("command_line"), "signed": a("file_signed_status"),
        "task": F.coalesce(a("task_name"), a("service_name")), "channel": a("channel"), "log_name": a("log_name"),
        "parent": forward_slashes(a("parent_path")), "process_path": forward_slashes(a("process_path")),
        "own_path": forward_slashes(a("file_path")),
        "source": F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("source_short", "source_long")]),
        "event_id": whole_number(a("event_id")).try_cast("int"), "log_event_id": whole_number(a("event_identifier")).try_cast("int"),
        "domain": a("domain"), "remote_host": a("remote_host"), "remote_domain": a("remote_domain"),
        "remote_host_name": a("remote_host_name"), "url_host": url_host(a("url")),
        "remote_port": F.coalesce(real_number(a("remote_port")).try_cast("int"), F.lit(0)),
    }
    raw["log_file"] = F.concat(F.replace(raw["channel"], F.lit("/"), F.lit("%4")), F.lit(".evtx"))
    df = df.select("*", *[c.alias(f"_f_{n}") for n, c in raw.items()])
    own, process = F.col("_f_own_name"), F.col("_f_process")
    name = F.coalesce(own, process)

    def ext(one: Column, other: Column) -> Column:
        first = extension(F.coalesce(one, F.lit("")))
        return F.when(first != "", first).otherwise(extension(F.coalesce(other, F.lit(""))))

    path = F.coalesce("_f_own_path", "_f_process_path")
    derived = {
        "name": name, "tool": F.coalesce(process, own), "path": F.lower(path), "process_path_low": F.lower("_f_process_path"),
        "name_low": F.lower(name), "process_low": F.lower(process), "stem_low": F.lower(without_extension(name)),
        "process_stem_low": F.lower(without_extension(process)), "process_stem": without_extension(process),
        "own_stem": without_extension(own), "ext": F.nullif(ext(own, process), F.lit("")), "name_ext": ext(name, process),
        "library_ext": ext(name, path), "target": F.coalesce("_f_domain", "_f_remote_host", "_f_remote_domain", "_f_remote_host_name"), "command_low": F.lower("_f_command"),
    }
    return df.select("*", *[c.alias(f"_f_{n}") for n, c in derived.items()])


def f(name: str) -> Column:
    return F.col(f"_f_{name}")


def _find(pattern: str, *cols: Column) -> Column:
    """Pattern found in any of the columns; missing ones do not match."""
    return F.coalesce(any_of([F.coalesce(c.rlike(pattern), F.lit(False)) for c in cols]), F.lit(False))


def file_hits(rules: RuleSet, index: Index) -> None:
    """File-correlated rules: all criteria that are set must hold, at least one of
    which must look at content."""
    for rule in rules.files:
        asked = {c: [p] if isinstance(p, str) else p for c in FILE_CRITERIA if (p := rule[c])}
        if not asked:
            continue
        tests = []
        for c, patterns in asked.items():
            # Every argument must be found, one of the extensions.
            tests += [index.test(FILE_CRITERIA[c], "find", some) for some in ([[p] for p in patterns] if c == "arguments" else [patterns])]
        tests += [index.test([c], "find", [rule[k]]) for c, k in (("signed", "signed"), ("source", "sources")) if rule[k]]
        # An extension opens the gate to very many files, so it does where nothing else is set.
        gate = min(asked, key=lambda c: c == "extensions")
        index.entry(index.rule(rule, "FileCorrelated", None), tests, group=f"file {gate}",
                    patterns=asked[gate][:1] if gate == "arguments" else asked[gate], types=rule["event_types"])


def token_hits(rules: RuleSet, index: Index) -> None:
    """Argument tokens in the command line of PowerShell processes."""
    for r in rules.tokens:
        tests = [index.test(["process_low"], "contains", [POWERSHELL]), index.test(["command_low"], "contains", [r["token"]])]
        index.entry(index.rule(r, "PowershellArgs", r["token"]), tests, group="token", patterns=[re.escape(r["token"])])


def event_hits(rules: RuleSet, index: Index, log_ids: bool = True) -> None:
    """Event-log rules, by event id. With `log_ids` the id of event-log records
    counts too, not only that of log lines."""
    for rule in rules.events:
        if not rule["event_ids"]:
            continue
        tests = [index.test(fields, "find", [rule[c]]) for c, fields in (
            ("log_file", ["channel", "log_name", "log_file"]), ("log_names", ["channel", "log_name"])) if rule[c]]
        for name, pattern in rule["payload"].items():
            snake = "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(name)).replace(" ", "_")
            tests.append(index.test([], "find", [pattern], names=list(dict.fromkeys([name, snake, name.lower().replace(" ", "_")]))))
        index.entry(index.rule(rule, "EventsMatching"), tests, keys=[f"{'id' if log_ids else 'own_id'}:{i}" for i in rule["event_ids"]])


def host_suffixes(host: Column) -> Column:
    """`a.b.c` -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _exclusions(rules: RuleSet) -> Index:
    """Common domains and host/port pairs that never count."""
    index = Index(FACETS)
    for pattern in rules.common_domains:
        index.entry(index.rule({"rule_id": ""}, "Excluded"), [index.test(["target"], "find", [pattern])], group="common", patterns=[pattern])
    for pattern, number in rules.host_ports:
        index.entry(index.rule({"rule_id": ""}, "Excluded"), [index.test(["target"], "find", [pattern])], keys=[f"port:{number}"])
    return index


def excluded_network(rules: RuleSet, wide: bool = True) -> Column:
    """Whether the event's network target is one that never counts."""
    index = _exclusions(rules)
    if not index.entries:
        return F.lit(False)
    target = f("target") if wide else F.coalesce(f("domain"), f("remote_host"))
    tests, none = [], F.expr("cast(map() as map<string,string>)")
    if (pattern := index.pattern("common")) is not None:
        tests.append(F.coalesce(target.rlike(pattern), F.lit(False)))
    if index.keys:
        found = index.under(F.array(F.concat(F.lit("port:"), f("remote_port").cast("string"))), none)
        facets = F.array(*[target if n == "target" else F.lit(None).cast("string") for n in FACETS])
        held = index.holding(found, facets, F.lit(""), none)
        tests.append(F.when(target.isNotNull() & (F.size(found) > 0), F.size(held) > 0).otherwise(F.lit(False)))
    return any_of(tests)


def domain_hits(rules: RuleSet, index: Index, wide: bool = True, one_label: bool = False) -> None:
    """Domain rules on the domain, remote host and URL host of an event.

    `**.name` globs are looked up by host suffix; other globs stay patterns.
    `one_label` restricts `**.` to a single leading label.
    """
    hosts = ["domain", "remote_host", "url_host"] + (["remote_domain", "remote_host_name"] if wide else [])
    index.hosts, index.exclude = hosts, (rules, wide)
    for rule in rules.domains:
        base, number = rule["glob"].removeprefix("**."), index.rule(rule, "Domain", rule["provider"])
        if rule["glob"].startswith("**.") and "*" not in base:
            # With one label, that of the leading ones that may be missing is cut by the test.
            tests = [index.test(hosts, "find", [anywhere(domain_glob(rule["glob"], True))])] if one_label else []
            index.entry(number, tests, keys=[f"host:{base}"])
        else:
            pattern = anywhere(domain_glob(rule["glob"], one_label))
            index.entry(number, [index.test(hosts, "find", [pattern])], group="domain", patterns=[pattern])


def remote_hits(rules: RuleSet, index: Index) -> None:
    """Remote-management paths: entries are alternatives, the fields of an
    entry must all hold."""
    for rule in rules.remote:
        shown = {"rule_id": rule["rule_id"], "analysis_type": REMOTE_TYPE, "score": REMOTE_SCORE}
        number = None
        for entry in rule["entries"]:
            tests, keys = [], []
            if entry["extensions"]:
                tests.append(index.test(["name_ext"], "in", entry["extensions"]))
                keys = [f"name_ext:{e}" for e in entry["extensions"]]
            if entry["path"]:
                tests.append(index.test(["path", "process_path_low"], "find", [entry["path"]]))
            if entry["stem"]:
                tests.append(index.test(["stem_low", "process_stem_low"], "in", [entry["stem"]]))
                keys = [f"stem:{entry['stem']}"]
            if entry["name"]:
                tests.append(index.test(["name_low", "process_low"], "in", [entry["name"]]))
                keys = [f"name:{entry['name']}"]
            if not tests:
                continue
            number = index.rule(shown, "RemoteManagement", rule["tool"]) if number is None else number
            if keys:
                index.entry(number, tests, keys=keys)
            else:
                index.entry(number, tests, group="remote", patterns=[entry["path"]])


def tool_hits(rules: RuleSet, index: Index) -> None:
    """Transfer-tool file names, optionally limited to event types."""
    for rule in rules.tools:
        number = index.rule(rule, "ExecutableType", rule["tool"]) if rule["entries"] else None
        for entry in rule["entries"]:
            index.entry(number, [index.test(["name_low"], "in", [entry["name"]])], keys=[f"name:{entry['name']}"], types=entry["event_types"])


def library_hits(rules: RuleSet, index: Index) -> None:
    """Paths of loaded libraries; `{0}` in the text is the file name."""
    for rule in rules.libraries:
        if not (rule["path"] or rule["stem"]):
            continue
        shown = {"rule_id": rule["rule_id"], "analysis_type": LIBRARY_TYPE, "score": rule["score"], "justification": rule["justification"]}
        tests = [index.test(["library_ext"], "in", rule["extensions"] or LIBRARY_EXTENSIONS), index.test(["path"], "find", [rule["path"] or ""])]
        if rule["stem"]:
            tests.append(index.test(["stem_low"], "find", [rule["stem"]]))
        gate = "path" if rule["path"] else "stem"
        index.entry(index.rule(shown, "LibNotOnDisk"), tests, group=f"library {gate}", patterns=[rule[gate]])


def _keys(index: Index) -> Column | None:
    """What of a row the index has keys for."""
    text = lambda kind, col: F.concat(F.lit(f"{kind}:"), col.cast("string"))
    of = {
        "id": [F.coalesce(f("event_id"), f("log_event_id"))], "own_id": [f("event_id")], "name": [f("name_low"), f("process_low")],
        "stem": [f("stem_low"), f("process_stem_low")], "name_ext": [f("name_ext")],
    }
    keys = [text(kind, c) for kind, columns in of.items() if kind in index.kinds() for c in columns]
    return F.array_compact(F.array(*keys)) if keys else None


def _candidates(index: Index) -> Column:
    """Numbers of the entries whose key or gate fits the row."""
    found = []
    index.part("groups")
    if (keys := _keys(index)) is not None:
        found.append(index.under(keys, F.col("attrs")))
    gates = {f"file {c}": fields for c, fields in FILE_CRITERIA.items()} | {
        "remote": ["path", "process_path_low"], "library path": ["path"], "library stem": ["stem_low"]}
    for group, fields in gates.items():
        if (pattern := index.pattern(group)) is not None:
            gate = _find(pattern, *map(f, fields))
            found.append(index.of_group(group, (f("library_ext") != "") & gate if group.startswith("library") else gate, *map(f, fields)))
    if (pattern := index.pattern("token")) is not None:
        found.append(index.of_group("token", f("process_low").contains(POWERSHELL) & _find(pattern, f("command_low")), f("command_low")))
    if "host" in index.kinds() or index.groups.get("domain"):
        hosts, (rules, wide) = [f(h) for h in index.hosts], index.exclude
        present = F.array_distinct(F.transform(F.array_compact(F.array(*hosts)), F.lower))
        named = []
        if "host" in index.kinds():
            suffixes = F.transform(F.flatten(F.transform(present, host_suffixes)), lambda s: F.concat(F.lit("host:"), s))
            named.append(index.under(suffixes, F.col("attrs")))
        if (pattern := index.pattern("domain")) is not None:
            named.append(index.of_group("domain", _find(pattern, *hosts), *hosts))
        some = any_of([h.isNotNull() for h in hosts])
        found.append(F.when(some & ~excluded_network(rules, wide), F.concat(*named)).otherwise(F.expr(NO_ENTRIES)))
    return F.concat(*found) if found else F.expr(NO_ENTRIES)


def template_fields() -> Column:
    """Everything a justification template may name."""
    base = F.create_map(*[
        c for name in ("message", "event_type", "host_name", "data_type", "source_short") for c in (F.lit(name), F.col(name))
    ])
    return overlay(base, F.col("attrs"))


def spell_out(numbers: Column, rules: Column) -> Column:
    """Rule numbers -> hit structs. Rows without hits skip all of it."""

    def hit(number: Column) -> Column:
        e = F.get(rules, number)
        text = F.replace(e["justification"], F.lit("{0}"), F.coalesce(f("name"), F.lit("")))
        text = F.when(text.contains("${"), fill_template(text, template_fields())).otherwise(text)
        return F.struct(
            e["rule_id"].alias("rule_id"), e["plugin"].alias("plugin"), e["analysis_type"].alias("analysis_type"),
            e["score"].alias("score"), text.alias("justification"), e["mitre"].alias("mitre"),
            F.coalesce(e["tool"], f("tool"), F.lit("")).alias("tool_name"),
        ).cast(HIT)

    return F.when(F.size(numbers) > 0, F.transform(numbers, hit)).otherwise(F.expr(NO_HITS))


PLUGINS = (file_hits, token_hits, event_hits, domain_hits, remote_hits, tool_hits, library_hits)


def detect(df: DataFrame, rules: RuleSet, plugins: tuple = PLUGINS, **options: dict) -> DataFrame:
    """Add `detections`: every rule hit of the event, in plugin and rule order.

    `options` maps a plugin name to keyword arguments, such as
    `domain_hits={"one_label": True}`.
    """
    index = Index(FACETS)
    for p in plugins:
        p(rules, index, **options.get(p.__name__, {}))
    if not index.entries:
        return df.withColumn("detections", F.expr(NO_HITS))
    # Keys and gates are evaluated once per event; tests only where one fits.
    marked = with_facets(df).withColumn("_some", once(_candidates(index)))
    # What no test looks at stays out, so that Spark does not work it out for every event.
    used, none = index.used(), F.lit(None).cast("string")
    facets = F.array(*[f(n) if n in used else none for n in FACETS])
    marked = marked.withColumn("_facets", once(F.when(F.size("_some") > 0, facets)))
    held = index.holding(F.col("_some"), F.col("_facets"), F.col("event_type"), F.col("attrs"))
    marked = marked.withColumn("_hits", once(F.when(F.size("_some") > 0, held).otherwise(F.expr(NO_ENTRIES))))
    return marked.withColumn("detections", spell_out(F.col("_hits"), index.part("rules"))).select(*df.columns, "detections")


def detections(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rule hit."""
    return df.select(*keys, F.inline("detections"))


def fold(df: DataFrame, rules: RuleSet, prefix: str = "cloudrules") -> DataFrame:
    """Fold `detections` into tags and attributes of the event, in its own row."""
    hits = F.col("detections")
    names = F.array_distinct(F.transform(hits, lambda d: F.concat(
        F.when(d["plugin"] != "", F.concat(d["plugin"], F.lit(": "))).otherwise(F.lit("")),
        F.when(d["tool_name"] != "", d["tool_name"]).otherwise(d["analysis_type"]),
    )))
    types = F.array_distinct(F.transform(hits, lambda d: d["analysis_type"]))
    scores = F.array_distinct(F.transform(hits, lambda d: d["score"]))
    known = F.split(F.coalesce(F.col("attrs")["mitre_attack"], F.lit("")), ", *")
    techniques = F.array_sort(F.array_distinct(F.filter(
        F.concat(F.transform(known, F.trim), F.flatten(F.transform(hits, lambda d: d["mitre"]))), lambda m: m != ""
    )))
    impact = (
        F.get(F.filter(F.transform(types, lambda t: literal_map(rules.impact)[t]), lambda i: i.isNotNull()), F.lit(0))
        if rules.impact else F.lit(None).cast("string")
    )
    added = {
        # The short text names five rules; where there are more, all are listed beside it.
        f"{prefix}_rule": join_capped(names),
        f"{prefix}_rules": F.when(F.size(names) > 5, F.array_join(names, "; ")),
        f"{prefix}_rule_id": F.array_join(F.array_distinct(F.transform(hits, lambda d: d["rule_id"])), "; "),
        f"{prefix}_score": highest(scores, SCORE_RANK),
        f"{prefix}_detection_count": F.size(hits).cast("string"),
        f"{prefix}_analysis_type": F.array_join(types, "; "),
        f"{prefix}_justification": F.array_join(F.array_distinct(F.transform(hits, lambda d: d["justification"])), " | "),
        f"{prefix}_impact": impact,
        "mitre_attack": F.array_join(techniques, ", "),
    }
    flat = [c for k, v in added.items() for c in (F.lit(k), v)]
    new = F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))
    tags = F.col("tags") if "tags" in df.columns else F.expr("cast(array() as array<string>)")
    marked = F.array_distinct(F.concat(
        F.coalesce(tags, F.expr("cast(array() as array<string>)")), F.array(F.lit(prefix)),
        F.transform(scores, lambda s: F.concat(F.lit(prefix + ":"), F.lower(s))),
    ))
    any_hit = F.size(hits) > 0
    return df.withColumn("tags", F.when(any_hit, marked).otherwise(tags)).withColumn(
        "attrs", F.when(any_hit, overlay(F.col("attrs"), new)).otherwise(F.col("attrs"))
    )


def detection_summary(hits: DataFrame) -> DataFrame:
    """Hits per score, plugin and type, in one pass over the hits."""
    facet = F.explode(F.array(*[
        F.struct(F.lit(k).alias("facet"), F.col(c).alias("value"))
        for k, c in (("score", "score"), ("plugin", "plugin"), ("type", "analysis_type"))
    ]))
    return hits.select(facet.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- Sigma

def tag_sigma(df: DataFrame, found: DataFrame, prefix: str = "hayabusa") -> DataFrame:
    """Tag events with the Sigma detections of their log record.

    `found`: upload_id, channel, record_number, seq, title, rule_id, level,
    mitre (text). Repeated hits of a rule are counted first and the rules of a
    record then folded to one row, so no group outgrows the rule set and the
    join adds no rows; Spark picks broadcast or sort-merge by measured size.
    """
    keys = ["upload_id", "channel", "record_number"]
    counted = found.groupBy(*keys, "title", "rule_id", "level", "mitre").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")
    )
    item = F.struct("seq", "title", "rule_id", "level", "mitre", "n")
    folded = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    # Events without a record number match nothing; as NULL keys they would all
    # meet in one task, so they are given spread keys instead.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("message", "seq"), F.lit(100_000)).cast("string"))
    left = df.withColumn("_channel", F.coalesce(attr(df, "channel"), F.lit(""))).withColumn(
        "_record", F.coalesce(attr(df, "record_number"), spread)
    )
    right = folded.select(
        F.col("upload_id"), F.col("channel").alias("_channel"), F.col("record_number").alias("_record"), "_s"
    )
    joined = left.join(right, ["upload_id", "_channel", "_record"], "left")
    s = F.col("_s")
    levels = F.array_distinct(F.transform(s, lambda d: d["level"]))
    techniques = F.array_sort(F.array_distinct(F.flatten(
        F.transform(F.filter(s, lambda d: d["mitre"] != ""), lambda d: F.split(d["mitre"], ", "))
    )))
    total = F.aggregate(s, F.lit(0).cast("long"), lambda acc, d: acc + d["n"])
    added = {
        f"{prefix}_rule": join_capped(F.transform(s, lambda d: d["title"])),
        f"{prefix}_rules": F.when(F.size(s) > 5, F.array_join(F.transform(s, lambda d: d["title"]), "; ")),
        f"{prefix}_rule_id": F.array_join(F.filter(F.transform(s, lambda d: d["rule_id"]), lambda r: r != ""), "; "),
        f"{prefix}_level": highest(levels, LEVEL_RANK),
        f"{prefix}_detection_count": total.cast("string"),
        "mitre_attack": F.array_join(techniques, ", "),
    }
    flat = [c for k, v in added.items() for c in (F.lit(k), v)]
    new = F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))
    tags = F.col("tags") if "tags" in df.columns else F.expr("cast(array() as array<string>)")
    marks = F.concat(F.array(F.lit(prefix), F.lit("sigma")), F.transform(levels, lambda v: F.concat(F.lit(prefix + ":"), v)))
    out = joined.withColumn(
        "tags", F.when(s.isNotNull(), F.array_distinct(F.concat(F.coalesce(tags, F.expr("cast(array() as array<string>)")), marks))).otherwise(tags)
    ).withColumn("attrs", F.when(s.isNotNull(), overlay(F.col("attrs"), new)).otherwise(F.col("attrs")))
    return out.select(*[c for c in df.columns if c != "tags"], "tags")


def drop_excluded_sigma(df: DataFrame, excluded: set[str], prefix: str = "hayabusa") -> DataFrame:
    """Take the Sigma tags and fields off events one of whose rules is on the
    exclusion list."""
    if not excluded:
        return df
    ids = F.transform(F.split(F.coalesce(F.col("attrs")[f"{prefix}_rule_id"], F.lit("")), "; "), F.trim)
    hit = F.exists(ids, lambda i: i.isin(sorted(excluded)))
    gone = [f"{prefix}_{n}" for n in ("rule", "rules", "rule_id", "level", "detection_count")]
    attrs = F.map_filter("attrs", lambda k, _: ~k.isin(gone))
    tags = F.filter("tags", lambda t: ~t.startswith(prefix) & (t != "sigma"))
    return df.withColumn("_hit", hit).withColumn("tags", F.when(F.col("_hit"), tags).otherwise(F.col("tags"))).withColumn(
        "attrs", F.when(F.col("_hit"), attrs).otherwise(F.col("attrs"))
    ).drop("_hit")


def sigma_summary(found: DataFrame) -> DataFrame:
    """Detections per level and per rule title. Titles are whole: rules that begin
    alike stay apart, and a display may cut them."""
    facet = F.explode(F.array(
        F.struct(F.lit("level").alias("facet"), F.col("level").alias("value")),
        F.struct(F.lit("rule").alias("facet"), F.col("title").alias("value")),
    ))
    return found.select(facet.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
