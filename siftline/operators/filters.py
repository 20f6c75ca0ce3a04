"""Event filters: a predicate tree in, a filtered DataFrame out.

A predicate is a dict, e.g. `{"and": [{"field": "event_type", "eq": "x"},
{"not": {"field": "IpAddress", "prefix": "10."}}]}`. Top-level names address
columns, any other name the attribute bag; promoted attributes use their column
so that the condition reaches the Parquet scan. NULL logic is SQL's own: a
negated comparison drops rows that lack the field.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.values import all_of, any_of
from siftline.schema import TOP_LEVEL

NOTABLE = "LikelyNotable"

# Fixed value: words the full-text part ignores.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()


def attr(df: DataFrame, name: str) -> Column:
    """Attribute by name: promoted column where there is one, else the bag."""
    if name in df.columns and name not in TOP_LEVEL:
        return F.col(name)
    return F.col("attrs")[name]


def field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in TOP_LEVEL else attr(df, name)


def exists(df: DataFrame, name: str) -> Column:
    """Top-level: not NULL. Attribute: the key is present, even with a NULL."""
    if name in TOP_LEVEL:
        return F.col(name).isNotNull()
    if "attrs" in df.columns:
        return F.coalesce(F.map_contains_key("attrs", F.lit(name)), F.lit(False))
    return F.col(name).isNotNull()


def contains_ci(col: Column, text: str) -> Column:
    return F.contains(F.lower(col), F.lit(text.lower()))


def starts_ci(col: Column, text: str) -> Column:
    return F.startswith(F.lower(col), F.lit(text.lower()))


def predicate(df: DataFrame, spec: dict) -> Column:
    """Column of one predicate tree."""
    if "and" in spec:
        return all_of([predicate(df, s) for s in spec["and"]])
    if "or" in spec:
        return any_of([predicate(df, s) for s in spec["or"]])
    if "not" in spec:
        return ~predicate(df, spec["not"])
    name = spec["field"]
    if spec.get("exists"):
        return exists(df, name)
    if name == "is_suspicious":
        wanted = str(spec["eq"]).lower() in ("true", "1", "yes")
        return F.col(name) == F.lit(wanted)
    col = field(df, name)
    if "in" in spec:
        return col.isin(list(spec["in"]))
    if "prefix" in spec:
        return contains_ci(col, spec["prefix"]) if name == "message" else starts_ci(col, spec["prefix"])
    if "contains" in spec:
        return contains_ci(col, spec["contains"])
    if name == "message":
        return contains_ci(col, spec["eq"])
    return col == spec["eq"]


def where_events(df: DataFrame, spec: dict) -> DataFrame:
    return df.where(predicate(df, spec))


def words_match(message: Column, query: str) -> Column:
    """All words of the query occur in the message (stop words apart)."""
    words = [w for w in dict.fromkeys(split_words(query)) if w not in STOP_WORDS]
    if not words:
        return F.lit(False)
    tokens = F.split(F.lower(F.coalesce(message, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return all_of([F.array_contains(tokens, w) for w in words])


def split_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()


def search(df: DataFrame, query: str, whole_record: bool = True) -> Column:
    """Free search: all words in the message, or the text inside the message or
    anywhere in the record. The cheap substring tests come first."""
    tests = [contains_ci(F.col("message"), query), words_match(F.col("message"), query)]
    if whole_record and "attrs" in df.columns:
        # Keys and values as they are: in JSON text backslashes and quotes are escaped.
        bag = F.concat(F.map_keys("attrs"), F.map_values("attrs"))
        tests.insert(1, F.exists(bag, lambda v: F.coalesce(contains_ci(v, query), F.lit(False))))
    return any_of([F.coalesce(t, F.lit(False)) for t in tests])


def time_range(start: str | datetime | None, end: str | datetime | None) -> Column:
    """Both ends inclusive; an open end does not filter."""
    tests = []
    if start is not None:
        tests.append(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("datetime") <= F.lit(end).cast("timestamp"))
    return all_of(tests) if tests else F.lit(True)


def finding_state(state: str) -> Column:
    if state == "none":
        return F.col("finding").isNull()
    if state == "any":
        return F.col("finding").isNotNull()
    return F.col("finding") == state


def query_events(
    df: DataFrame, *, site: str | None = None, upload: str | None = None, event_types: list[str] | None = None,
    text: str | None = None, finding: str | None = None, notable: bool = False, suspicious: bool = False,
    start: str | None = None, end: str | None = None, channel: str | None = None,
    data: dict[str, str] | None = None, spec: dict | None = None,
) -> DataFrame:
    """All filters of the event query; those given are combined with AND."""
    if site is not None:
        df = df.where(F.col("site_id") == site)
    if upload is not None:
        df = df.where(F.col("upload_id") == upload)
    if event_types:
        df = df.where(F.col("event_type").isin(event_types))
    if start is not None or end is not None:
        df = df.where(time_range(start, end))
    if finding:
        df = df.where(finding_state(finding))
    if notable:
        df = df.where(F.col("ct_significance") == NOTABLE)
    if suspicious:
        df = df.where(F.col("is_suspicious"))
    if channel:
        df = df.where(attr(df, "channel") == channel)
    for name, value in (data or {}).items():
        df = df.where(attr(df, name) == value)
    if spec:
        df = where_events(df, spec)
    if text:
        df = df.where(search(df, text))
    return df


def jump_window(day: str, clock: str = "00:00") -> tuple[str, str]:
    """One-hour window of the jump-to-time box; the last hour does not wrap."""
    hour, minute = (int(p) for p in clock.split(":"))
    return f"{day} {clock}:00", f"{day} {min(hour + 1, 23):02d}:{minute:02d}:59"


def hide_machine_accounts(users: DataFrame, text: str = "", show_machines: bool = False) -> DataFrame:
    """Filter of the logon summary: accounts ending in `$`, and a text looked
    up in user, domain and packages."""
    if not show_machines:
        users = users.where(~F.endswith("username", F.lit("$")))
    if text:
        hits = [F.coalesce(contains_ci(F.col(c), text), F.lit(False)) for c in ("username", "domain", "auth_packages")]
        users = users.where(any_of(hits))
    return users


def by_name(entries: DataFrame, text: str) -> DataFrame:
    """Directory entries whose name contains the text, in any case."""
    return entries.where(contains_ci(F.col("name"), text))


def by_artifact(catalog: DataFrame, name_pattern: str = "", path_pattern: str = "") -> DataFrame:
    """Catalogue rows whose file name and path match the patterns (any case)."""
    if name_pattern:
        catalog = catalog.where(F.col("file_name").rlike("(?i)" + name_pattern))
    if path_pattern:
        catalog = catalog.where(F.col("path").rlike("(?i)" + path_pattern))
    return catalog


# ---------------------------------------------------------------- fixed values
_WEB = [
    "browser_history", "registry_typedurls", "file_access", "registry_recentdocs", "lnk_target", "registry_runmru",
    "registry_shellbag", "file_deleted",
]
_PROCESS = [
    "windows_process", "running_process", "process_execution", "prefetch_execution", "registry_bam",
    "registry_amcache", "registry_userassist",
]
_NETWORK_ALL = [
    "network_connection", "active_connection", "network_share", "windows_smb", "windows_dns", "dns_cache_entry",
    "dhcp_event", "windows_dhcp",
]
_LOGON = ["windows_logon", "windows_authentication", "windows_rdp", "session_logon"]
VIEWS: dict[str, dict] = {
    "processes": {"event_types": _PROCESS},
    "processes.created": {"event_types": ["windows_process", "running_process"]},
    "processes.execution": {"event_types": ["process_execution", "prefetch_execution"]},
    "processes.bam": {"event_types": ["registry_bam"]},
    "processes.amcache": {"event_types": ["registry_amcache"]},
    "processes.userassist": {"event_types": ["registry_userassist"]},
    "services": {"event_types": ["registry_service", "windows_service"]},
    "services.registry": {"event_types": ["registry_service"]},
    "services.runtime": {"event_types": ["windows_service"]},
    "services.running": {"event_types": ["windows_service"], "data": {"param2": "running"}},
    "services.stopped": {"event_types": ["windows_service"], "data": {"param2": "stopped"}},
    "persistence": {"event_types": ["startup_item", "wmi_persistence", "registry_winlogon"]},
    "persistence.startup": {"event_types": ["startup_item"]},
    "persistence.wmi": {"event_types": ["wmi_persistence"]},
    "persistence.winlogon": {"event_types": ["registry_winlogon"]},
    "network": {"event_types": _NETWORK_ALL},
    "network.all": {"event_types": ["network_connection", "active_connection"]},
    "network.shares": {"event_types": ["network_share"]},
    "network.smb": {"event_types": ["windows_smb"]},
    "network.dns": {"event_types": ["windows_dns", "dns_cache_entry"]},
    "network.dhcp": {"event_types": ["dhcp_event", "windows_dhcp"]},
    "web": {"event_types": _WEB},
    "web.browser": {"event_types": ["browser_history"]},
    "web.urls": {"event_types": ["registry_typedurls"]},
    "web.access": {"event_types": ["file_access"]},
    "web.shortcuts": {"event_types": ["lnk_target"]},
    "web.deleted": {"event_types": ["file_deleted"]},
    "web.shellbags": {"event_types": ["registry_shellbag"]},
    "usage": {"event_types": ["srum_app_usage", "srum_network_connectivity"]},
    "usage.app": {"event_types": ["srum_app_usage"]},
    "usage.net": {"event_types": ["srum_network_connectivity"]},
    "system": {"event_types": ["registry_software", "registry_networklist", "os_config"]},
    "system.software": {"event_types": ["registry_software"]},
    "system.network": {"event_types": ["registry_networklist"]},
    "system.sysconfig": {"event_types": ["os_config"]},
    "accounts": {"event_types": ["account_created"]},
    "defender": {"event_types": ["windows_defender"]},
    "powershell": {"event_types": ["powershell_history", "windows_powershell"]},
    "powershell.history": {"event_types": ["powershell_history"]},
    "powershell.scripts": {"event_types": ["windows_powershell"]},
    "eventlog": {"event_types": ["windows_event"]},
    "eventlog.sysmon": {"event_types": ["windows_event"], "channel": "Microsoft-Windows-Sysmon/Operational"},
    "eventlog.security": {"event_types": ["windows_event"], "channel": "Security"},
    "eventlog.application": {"event_types": ["windows_event"], "channel": "Application"},
    "eventlog.system": {"event_types": ["windows_event"], "channel": "System"},
    "eventlog.firewall": {
        "event_types": ["windows_event"],
        "channel": "Microsoft-Windows-Windows Firewall With Advanced Security/Firewall",
    },
    "eventlog.winrm": {"event_types": ["windows_event"], "channel": "Microsoft-Windows-WinRM/Operational"},
    "logons": {"event_types": _LOGON},
    "logons.success": {"event_types": ["windows_logon"], "data": {"event_identifier": "4624"}},
    "logons.failed": {"event_types": ["windows_logon"], "data": {"event_identifier": "4625"}},
    "logons.rdp": {"event_types": ["windows_rdp"]},
    "logons.auth": {"event_types": ["windows_authentication"]},
    "logons.sessions": {"event_types": ["session_logon"]},
    "findings.notable": {"notable": True},
    "findings.suspicious_flag": {"suspicious": True},
    "findings.bad": {"finding": "bad"},
    "findings.suspicious": {"finding": "suspicious"},
    "findings.good": {"finding": "good"},
    "findings.any": {"finding": "any"},
}
# ------------------------------------------------------------ end fixed values


def view(df: DataFrame, name: str) -> DataFrame:
    """One of the named views (saved filters)."""
    return query_events(df, **VIEWS[name])
