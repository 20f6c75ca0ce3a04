"""Code-to-label lookups and channel / provider naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
LOGON_TYPES = {
    "2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock",
    "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive",
}
LOGON_TYPES_SHORT = LOGON_TYPES | {"8": "NetworkClear", "9": "NewCreds"}

DHCP_CODES = {
    "10": "New Lease", "11": "Renewed Lease", "12": "Released Lease", "13": "Duplicate IP",
    "14": "Lease Expired", "15": "Lease Denied", "17": "Lease Expired/Deleted",
    "18": "Lease Expired/Deactivated", "20": "BOOTP Lease", "30": "DNS Update Request",
    "31": "DNS Update Failed", "32": "DNS Update Success", "36": "Lease Deleted (Cleanup)",
}
PERMISSION_STATES = {
    "0": "denied", "1": "unknown", "2": "allowed", "3": "limited", "4": "added_modified_by_user",
}
NETWORK_CATEGORIES = {"0": "Public", "1": "Private", "2": "Domain"}
ACTIVITY_DESCRIPTIONS = {
    "5": "File/Document Opened", "10": "Clipboard Activity",
    "11": "Settings Changed", "16": "Application Launched",
}
USAGE_STREAMS = {
    "/app/usage": ("application_usage", "App Used"),
    "/app/inFocus": ("application_focus", "App In Focus"),
    "/app/intents": ("app_intent", "App Intent"),
    "/app/activity": ("app_activity", "App Activity"),
    "/app/webUsage": ("web_usage", "Web Usage"),
    "/device/isLocked": ("device_lock", "Device Lock State"),
    "/display/isBacklit": ("display_state", "Display Backlit State"),
    "/battery/percentage": ("battery_level", "Battery Level"),
    "/portrait/topic": ("device_topic", "Device Topic"),
    "/safari/history": ("web_history", "Safari Browsing History"),
}
PROVIDERS = {
    "Security": "Microsoft-Windows-Security-Auditing",
    "System": "Microsoft-Windows-Kernel-General",
    "Microsoft-Windows-PowerShell/Operational": "Microsoft-Windows-PowerShell",
    "Windows PowerShell": "PowerShell",
    "PowerShell": "Microsoft-Windows-PowerShell",
    "Microsoft-Windows-TaskScheduler/Operational": "Microsoft-Windows-TaskScheduler",
    "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational":
        "Microsoft-Windows-TerminalServices-LocalSessionManager",
    "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational":
        "Microsoft-Windows-TerminalServices-RemoteConnectionManager",
    "Microsoft-Windows-Sysmon/Operational": "Microsoft-Windows-Sysmon",
    "Microsoft-Windows-Windows Defender/Operational": "Microsoft-Windows-Windows Defender",
    "Application": "Application",
    "Microsoft-Windows-WMI-Activity/Operational": "Microsoft-Windows-WMI-Activity",
    "Microsoft-Windows-Bits-Client/Operational": "Microsoft-Windows-Bits-Client",
    "Microsoft-Windows-DNS-Client/Operational": "Microsoft-Windows-DNS-Client",
    "DNS Server": "Microsoft-Windows-DNS-Server-Service",
    "Microsoft-Windows-Windows Firewall With Advanced Security/Firewall":
        "Microsoft-Windows-Windows Firewall With Advanced Security",
}
# Channel -> the event ids that belong to it when a record names no channel.
CHANNEL_EVENT_IDS = {
    "Security": [
        1102, 4616, 4624, 4625, 4634, 4647, 4648, 4656, 4658, 4660, 4662, 4663, 4672, 4673, 4674,
        4688, 4689, 4703, 4704, 4705, 4719, 4720, 4722, 4723, 4724, 4725, 4726, 4728, 4729, 4732,
        4733, 4740, 4756, 4757, 4768, 4769, 4770, 4771, 4773, 4774, 4775, 4776, 5136, 5137, 5138,
        5139, 5141, 5152, 5153, 5154, 5155, 5156, 5157, 5158, 5159, 6416,
    ],
    "System": [104, 1074, 6005, 6006, 6008, 6009, 6013, 7026, 7034, 7036, 7040, 7045],
    "Microsoft-Windows-Sysmon/Operational": [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18, 19, 20, 26],
    "Windows PowerShell": [400, 403, 500, 501, 600, 800],
    "Microsoft-Windows-PowerShell/Operational": [
        410, 411, 420, 4100, 4103, 4104, 4105, 4106, 40961, 40962,
    ],
    "Microsoft-Windows-TaskScheduler/Operational": [
        100, 102, 106, 107, 110, 118, 119, 129, 140, 141, 142, 200, 201,
    ],
    "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational": [21, 22, 23, 24, 25],
    "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational": [1149],
    "Microsoft-Windows-Windows Defender/Operational": [
        1000, 1001, 1002, 1005, 1006, 1007, 1008, 1116, 1117, 2000, 2001, 5001, 5004, 5007,
    ],
    "Microsoft-Windows-WMI-Activity/Operational": [5857, 5858, 5859, 5860, 5861],
    "Microsoft-Windows-AppLocker/EXE and DLL": [8002, 8003, 8004],
    "Microsoft-Windows-Windows Firewall With Advanced Security/Firewall": [2003, 2004, 2005, 2006],
}
SHORT_CHANNELS = {
    "Sec": "Security", "Sys": "System", "App": "Application",
    "Sysmon": "Microsoft-Windows-Sysmon/Operational",
    "PwSh": "Microsoft-Windows-PowerShell/Operational",
    "PwShClassic": "Windows PowerShell",
    "TaskSch": "Microsoft-Windows-TaskScheduler/Operational",
    "WinRM": "Microsoft-Windows-WinRM/Operational",
    "Defender": "Microsoft-Windows-Windows Defender/Operational",
    "TermServ": "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational",
    "RDP-Client": "Microsoft-Windows-TerminalServices-RDPClient/Operational",
    "Bits": "Microsoft-Windows-Bits-Client/Operational",
    "DNS": "Microsoft-Windows-DNS-Client/Operational",
    "Firewall": "Microsoft-Windows-Windows Firewall With Advanced Security/Firewall",
    "WMI": "Microsoft-Windows-WMI-Activity/Operational",
    "NTLM": "Microsoft-Windows-NTLM/Operational",
}
# ------------------------------------------------------------ end fixed values


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def label(col: Column, pairs: dict[str, str], prefix: str = "", default: str | None = None) -> Column:
    """Looked-up text; otherwise `default`, or `prefix` + code."""
    fallback = F.lit(default) if default is not None else F.concat(F.lit(prefix), col.cast("string"))
    return F.coalesce(literal_map(pairs)[col.cast("string")], fallback)


def logon_type(col: Column, short: bool = False) -> Column:
    return label(col, LOGON_TYPES_SHORT if short else LOGON_TYPES, prefix="Type ")


def dhcp_code(col: Column) -> Column:
    return label(col, DHCP_CODES, prefix="DHCP Event ")


def permission_state(col: Column) -> Column:
    return label(F.coalesce(col.cast("string"), F.lit("0")), PERMISSION_STATES, prefix="auth_")


def network_category(col: Column) -> Column:
    return label(F.coalesce(col.cast("string"), F.lit("0")), NETWORK_CATEGORIES, default="Unknown")


def activity_description(col: Column) -> Column:
    return label(col, ACTIVITY_DESCRIPTIONS, default="Windows Timeline Activity")


def usage_stream(col: Column) -> tuple[Column, Column]:
    """(event type, description) of a usage stream."""
    return (
        label(col, {k: v[0] for k, v in USAGE_STREAMS.items()}, default="device_event"),
        label(col, {k: v[1] for k, v in USAGE_STREAMS.items()}),
    )


def provider(channel: Column) -> Column:
    """Provider of a channel: exact name, then longest known name contained in
    it, then the part before the slash."""
    chain = F.when(F.coalesce(channel, F.lit("")).isin("", "Unknown"), F.lit("Unknown"))
    chain = chain.when(F.map_contains_key(literal_map(PROVIDERS), channel), literal_map(PROVIDERS)[channel])
    for known in sorted(PROVIDERS, key=lambda k: (-len(k), k)):
        chain = chain.when(F.lower(channel).contains(known.lower()), F.lit(PROVIDERS[known]))
    chain = chain.when(channel.contains("Microsoft-Windows-"), F.substring_index(channel, "/", 1))
    return chain.otherwise(channel)


def channel_of_event_id(event_id: Column) -> Column:
    """Channel of a well-known event id, else NULL."""
    chain = F.when(F.lit(False), F.lit(""))
    # The first channel in the list that has an id gets it.
    for name, ids in CHANNEL_EVENT_IDS.items():
        chain = chain.when(event_id.cast("int").isin(ids), F.lit(name))
    return chain


def full_channel(short: Column) -> Column:
    return F.coalesce(literal_map(SHORT_CHANNELS)[short], short)


def platform_of_source(col: Column) -> Column:
    text = F.lower(col)
    return (
        F.when(text.contains("macos") | text.contains("darwin"), F.lit("macos"))
        .when(text.contains("linux"), F.lit("linux"))
        .when(text.contains("esxi"), F.lit("esxi"))
        .when(text.contains("windows") | text.contains("evtx") | text.contains("registry"), F.lit("windows"))
    )
