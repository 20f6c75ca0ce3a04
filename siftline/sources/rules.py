"""Detection rule files: JSON (or gzipped JSON) with one `rules` array."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.patterns import anywhere, is_valid, path_glob

RULE_FILE = T.StructType([
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("ruleId", T.StringType()),
        T.StructField("ruleVersion", T.IntegerType()),
        T.StructField("plugin", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("ruleMetadata", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("payload", T.StringType()),
        ])),
    ]))),
])

# ---------------------------------------------------------------- fixed values
DATA_TYPE_EVENTS = {
    "PROCESS_INSTANCE": ["process_execution", "running_process"],
    "FILE": ["file_timeline", "file_timeline_fn", "file_access"],
    "WEB_ARTIFACT": ["web_visit", "web_download"],
    "USER_ACCESSED_DATA": ["file_access"],
    "TRIGGERED_TASK": ["scheduled_task", "triggered_task", "windows_task"],
    "SERVICE": ["windows_service"],
    "STARTUP_PROGRAM": ["startup_item"],
    "CONFIG_ITEM": ["os_config"],
    "SCHEDULED_TASK": ["scheduled_task", "triggered_task", "windows_task"],
}
FILE_PLUGIN = "FileCorrelatedCloudRulePlugin_v1"
TOKEN_PLUGIN = "PowershellArgsCloudRulePlugin_v1"
DOMAIN_PLUGIN = "DomainCloudRulePlugin_v1"
REMOTE_PLUGIN = "RemoteManagementCloudRulePlugin_v1"
EVENT_PLUGIN = "EventsMatchingCloudRulePlugin_v1"
TOOL_PLUGIN = "ExecutableTypeCloudRulePlugin_v1"
LIBRARY_PLUGIN = "LibNotOnDiskCloudRulePlugin_v1"
IMPACT_PLUGIN = "AnalysisResultImpactMappingCloudRulePlugin_v1"
SIGMA_PLUGIN = "HayabusaCloudRulePlugin_v1"
COMMON_DOMAIN_PLUGIN = "CommonBitsJobDomainCloudRulePlugin_v1"
HOST_PORT_PLUGIN = "HostPortExclusionCloudRulePlugin_v1"
# ------------------------------------------------------------ end fixed values


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the highest revision (last file by name) under `path`."""
    files = spark.read.schema(RULE_FILE).option("multiLine", True).json(path).select(
        F.col("_metadata.file_name").alias("file"), "rules"
    )
    latest = files.agg(F.max_by("rules", "file").alias("rules"))
    return latest.select(F.posexplode("rules").alias("rule_order", "r")).select(
        "rule_order", F.col("r.ruleId").alias("rule_id"), F.coalesce("r.ruleVersion", F.lit(0)).alias("version"),
        "r.plugin", F.coalesce("r.enabled", F.lit(False)).alias("enabled"),
        F.col("r.ruleMetadata.payload").alias("payload"), F.col("r.ruleMetadata").isNotNull().alias("has_metadata"),
    )


def current_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with metadata, of the highest version per rule id; ties
    are all kept."""
    usable = rules.where(F.col("enabled") & F.col("has_metadata"))
    newest = usable.groupBy("rule_id").agg(F.max("version").alias("version"))
    return usable.join(newest, ["rule_id", "version"], "left_semi").select(*rules.columns)


@dataclass
class RuleSet:
    """Prepared rules. A rule set is hand-written configuration (hundreds of
    entries, or a feed of some ten thousand domains), so it lives on the driver; events
    meet it as data (`operators.rule_index`). Its size is checked."""

    files: list[dict] = field(default_factory=list)
    tokens: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    domains: list[dict] = field(default_factory=list)
    remote: list[dict] = field(default_factory=list)
    tools: list[dict] = field(default_factory=list)
    libraries: list[dict] = field(default_factory=list)
    impact: dict[str, str] = field(default_factory=dict)
    sigma_excluded: set[str] = field(default_factory=set)
    common_domains: list[str] = field(default_factory=list)
    host_ports: list[tuple[str, int]] = field(default_factory=list)
    #: Rules that were left out, and why: a bad pattern must not widen its rule.
    dropped: list[tuple[str, str]] = field(default_factory=list)


class BadPattern(ValueError):
    pass


#: Characters of payloads that the driver takes; a rule set is hand-written or a feed.
MOST_CHARS = 64 << 20


def event_types_of(data_types: list[str] | None) -> list[str]:
    return sorted({e for d in data_types or [] for e in DATA_TYPE_EVENTS.get(d, [])})


def _result(rule_id: str, data: dict | None) -> dict:
    data = data or {}
    return {
        "rule_id": rule_id, "analysis_type": data.get("analysisResultType") or "", "score": data.get("score") or "",
        "justification": data.get("justification") or "",
        "mitre": [m["id"] for m in data.get("mitreAttackTypes") or [] if m.get("id")],
    }


def prepare_rules(spark: SparkSession, rules: DataFrame) -> RuleSet:
    """Current rules -> `RuleSet`. A rule with a pattern that the JVM rejects is left
    out as a whole, and so is a payload that is no JSON; both are told in `dropped`."""
    out = RuleSet()

    def usable(pattern: str | None) -> str | None:
        if pattern and not is_valid(spark, anywhere(pattern)):
            raise BadPattern(pattern)
        return anywhere(pattern) if pattern else None

    def usable_all(patterns: list[str] | None) -> list[str]:
        return [p for p in map(usable, patterns or []) if p]

    def glob(pattern: str | None) -> str | None:
        return anywhere(path_glob(pattern)) if pattern else None

    def lower(value: str | None) -> str:
        return (value or "").lower()

    def kept(rid: str, made: list[dict] | None, make: Callable[[dict], dict]) -> list[dict]:
        found = []
        for r in made or []:
            try:
                found.append(make(r))
            except BadPattern as e:
                out.dropped.append((rid, f"bad pattern {e}"))
        return found

    current = current_rules(rules)
    if (size := current.agg(F.sum(F.length("payload"))).first()[0] or 0) > MOST_CHARS:
        raise ValueError(f"a rule set of {size} characters is too large for the driver")
    for row in current.orderBy("rule_order").toLocalIterator():
        rid, plugin = row["rule_id"], row["plugin"]
        try:
            body = json.loads(row["payload"] or "{}")
        except ValueError:
            out.dropped.append((rid, "payload is no JSON"))
            continue
        if plugin == FILE_PLUGIN:
            def file_rule(r: dict) -> dict:
                m = r.get("matches") or {}
                return _result(rid, r.get("result")) | {
                    "event_types": event_types_of(m.get("dataTypes")),
                    "extensions": usable_all(m.get("extensions")), "arguments": usable_all(m.get("arguments")),
                } | {k: usable(m.get(v)) for k, v in {
                    "name": "fileName", "stem": "fileNameNoExt", "path": "path", "parent": "parentProcess",
                    "sources": "sources", "signed": "fileSignedStatus", "task": "taskName",
                }.items()}

            out.files += kept(rid, body.get("rules"), file_rule)
        elif plugin == TOKEN_PLUGIN:
            out.tokens += [_result(rid, r.get("result")) | {"token": lower(r.get("argToken"))} for r in body.get("rules") or []]
        elif plugin == EVENT_PLUGIN:
            def event_rule(r: dict) -> dict:
                m = r.get("matches") or {}
                payload = {k: usable(v) for k, v in (m.get("payload") or {}).items()}
                return _result(rid, r.get("result")) | {
                    "event_ids": [int(i) for i in m.get("eventIds") or []],
                    "log_file": usable(m.get("logFileName")), "log_names": usable(m.get("logNames")),
                    "payload": {k: v for k, v in payload.items() if v},
                }

            out.events += kept(rid, body.get("rules"), event_rule)
        elif plugin == DOMAIN_PLUGIN:
            out.domains += [
                _result(rid, d.get("newResultARData"))
                | {"glob": lower(d.get("domainStarPattern")), "provider": d.get("serviceProvider") or ""}
                for d in body.get("domains") or []
            ]
        elif plugin == REMOTE_PLUGIN:
            out.remote += [
                {
                    "rule_id": rid, "tool": (r.get("rmmRecord") or {}).get("id") or "",
                    "entries": [
                        {
                            "name": lower(m.get("fileName")), "stem": lower(m.get("fileNameNoExt")),
                            "path": glob(m.get("path")), "extensions": [lower(e) for e in m.get("extensions") or []],
                        }
                        for m in r.get("matchesPath") or []
                    ],
                }
                for r in body.get("rules") or []
            ]
        elif plugin == TOOL_PLUGIN:
            for r in body.get("rules") or []:
                record = r.get("record") or {}
                out.tools.append(_result(rid, record.get("newResult")) | {
                    "tool": record.get("id") or "",
                    "entries": [
                        {"name": lower(m.get("fileName")), "event_types": event_types_of(m.get("dataTypes"))}
                        for m in r.get("matches") or []
                    ],
                })
        elif plugin == LIBRARY_PLUGIN:
            for r in body.get("rules") or []:
                m, a = r.get("libToMatch") or {}, r.get("analysisResultData") or {}
                out.libraries.append({
                    "rule_id": rid, "path": glob(m.get("path")), "stem": glob(m.get("fileNameNoExt")),
                    "extensions": [lower(e) for e in m.get("extensions") or []],
                    "score": a.get("score") or "", "justification": a.get("justification") or "",
                })
        elif plugin == IMPACT_PLUGIN:
            out.impact |= {e["analysisResultType"]: e["impact"] for e in body.get("entries") or []}
        elif plugin == SIGMA_PLUGIN:
            out.sigma_excluded |= {line["guid"] for line in body.get("excludeRulesLines") or []}
        elif plugin == COMMON_DOMAIN_PLUGIN:
            out.common_domains += filter(None, kept(rid, body.get("commonBitsJobDomains"), lambda d: usable(d.get("host"))))
        elif plugin == HOST_PORT_PLUGIN:
            pairs = kept(rid, body.get("excludedHostPorts"), lambda p: (usable(p.get("host")), int(p.get("port") or 0)))
            out.host_ports += [(host, port) for host, port in pairs if host]
    return out
