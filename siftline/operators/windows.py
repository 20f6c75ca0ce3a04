"""Windows event records: category, message text and event builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.functions.times import filetime
from siftline.functions.values import flatten_one_level, once, overlay, parse_map, parse_maps, whole_number
from siftline.operators.build import Emit, build, builder, rec

# ---------------------------------------------------------------- fixed values
SECURITY_CATEGORIES = {
    "windows_logon": [4624, 4625, 4634, 4647, 4648, 4672],
    "windows_process": [4688, 4689],
    "windows_account": [4720, 4722, 4723, 4724, 4725, 4726, 4732, 4733],
    "windows_authentication": [4776, 4768, 4769, 4771],
    "windows_firewall": [5156, 5157, 5152, 5153, 5154, 5155, 5158, 5159],
}
# Channel words tested in this order once the security ids did not apply.
CHANNEL_CATEGORIES = [
    (["Task"], "windows_task"),
    (["TerminalServices"], "windows_rdp"),
    (["PowerShell"], "windows_powershell"),
    (["DNS"], "windows_dns"),
    (["SmbClient", "SMB"], "windows_smb"),
    (["Defender"], "windows_defender"),
    (["Dhcp", "DHCP"], "windows_dhcp"),
]
SERVICE_EVENT_IDS = [7045, 7040, 7036]
TASK_VERBS = {106: "registered", 200: "started", 201: "completed", 141: "deleted"}
TERMINAL_TEXTS = {
    21: "RDP session logon", 22: "RDP shell start", 23: "RDP session logoff",
    24: "RDP session disconnected", 25: "RDP session reconnected",
    1149: "RDP authentication succeeded",
}
LEASE_TEXTS = {11: "renewed", 12: "released", 15: "expired"}
# ------------------------------------------------------------ end fixed values


def _mentions(channel: Column, *words: str) -> Column:
    found = channel.contains(words[0])
    for w in words[1:]:
        found = found | channel.contains(w)
    return found


def category(event_id: Column, channel: Column) -> Column:
    """Event type of a Windows event from its id and channel."""
    security = channel.contains("Security")
    chain = F.when(F.lit(False), F.lit(""))
    for name, ids in SECURITY_CATEGORIES.items():
        chain = chain.when(security & event_id.isin(ids), F.lit(name))
    for words, name in CHANNEL_CATEGORIES:
        chain = chain.when(_mentions(channel, *words), F.lit(name))
    chain = chain.when(channel.contains("System") & event_id.isin(SERVICE_EVENT_IDS), F.lit("windows_service"))
    return chain.otherwise(F.lit("windows_event"))


def message(event_id: Column, channel: Column, get: Callable[[str], Column]) -> Column:
    """Readable text of a Windows event.

    `get(name)` gives a payload field ('' when absent). A channel that is
    handled ends the search even for ids it has no text for, except Security,
    PowerShell and System, which fall through to the general text.
    """

    def named(field: str, default: str = "Unknown") -> Column:
        return F.when(get(field) != "", get(field)).otherwise(F.lit(default))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    source = [get("SourceAddress"), get("SourcePort"), get("DestAddress"), get("DestPort")]
    flow = text(" ", source[0], ":", source[1], " → ", source[2], ":", source[3])
    security = {
        4624: text("Logon: ", named("TargetUserName"), " (Type ", named("LogonType", "?"), ")"),
        4625: text("Failed logon: ", named("TargetUserName")),
        4634: text("Logoff: ", named("TargetUserName")),
        4648: text("Explicit credentials: ", named("SubjectUserName"), " → ", named("TargetServerName")),
        4672: text("Special privileges assigned: ", named("SubjectUserName")),
        4688: text("Process created: ", named("NewProcessName"), " by ", named("SubjectUserName")),
        4689: text("Process exited: ", named("ProcessName")),
        4720: text("User account created: ", get("TargetUserName")),
        4726: text("User account deleted: ", get("TargetUserName")),
        4732: text("User ", get("MemberName"), " added to group ", get("TargetUserName")),
        4776: text("Credential validation: ", named("TargetUserName")),
        5156: text("WFP allowed: ", named("Application"), flow),
        5157: text("WFP blocked: ", named("Application"), flow),
        5152: text("WFP dropped packet: ", named("Application"), " ", source[0], " → ", source[2]),
    }
    powershell = {
        4104: text("PowerShell script: ", F.substring(get("ScriptBlockText"), 1, 100), "..."),
        400: F.lit("PowerShell engine started"),
        403: F.lit("PowerShell engine stopped"),
    }
    system = {
        7045: text("Service installed: ", get("ServiceName")),
        7040: text("Service start type changed: ", get("param1")),
    }

    address = F.when(get("IPAddress") != "", get("IPAddress")).otherwise(get("ipAddress"))
    leaseholder = F.when(get("HostName") != "", get("HostName")).otherwise(get("hostname"))
    lease = F.when(
        (event_id == 10) & (leaseholder != ""), text("DHCP: Lease assigned ", address, " to ", leaseholder)
    ).when(event_id == 10, text("DHCP: Lease assigned ", address))
    for code, verb in LEASE_TEXTS.items():
        lease = lease.when(event_id == code, text(f"DHCP: Lease {verb} ", address))
    lease = lease.otherwise(text("DHCP: Event ", event_id.cast("string")))

    task = F.when(get("TaskName") != "", get("TaskName")).otherwise(named("Name"))
    task_text = F.when(F.lit(False), F.lit(""))
    for code, verb in TASK_VERBS.items():
        task_text = task_text.when(event_id == code, text(f"Scheduled task {verb}: ", task))
    task_text = task_text.otherwise(text("Task Scheduler event ", event_id.cast("string"), ": ", task))

    who = F.when(get("User") != "", get("User")).otherwise(get("UserName"))
    where = F.when(get("Address") != "", get("Address")).otherwise(get("Param3"))
    visitor = (
        F.when(where == "LOCAL", text(who, " (local console)"))
        .when(where != "", text(who, " from ", where))
        .otherwise(who)
    )
    session = F.when(get("SessionID") != "", get("SessionID")).otherwise(get("Session"))
    terminal = F.when(event_id == 40, text("RDP session ", session, " disconnected (reason code in event)"))
    for code, lead in TERMINAL_TEXTS.items():
        terminal = terminal.when(event_id == code, text(f"{lead}: ", visitor))
    terminal = terminal.otherwise(text("Terminal Services event ", event_id.cast("string")))

    chain = F.when(F.lit(False), F.lit(""))
    for word, texts in (("Security", security), ("PowerShell", powershell)):
        for code, body in texts.items():
            chain = chain.when(channel.contains(word) & (event_id == code), body)
    chain = chain.when(_mentions(channel, "Dhcp", "DHCP"), lease)
    chain = chain.when(channel.contains("Task"), task_text)
    # Gateway channels also contain this word, so they take the same texts.
    chain = chain.when(channel.contains("TerminalServices"), terminal)
    for code, body in system.items():
        chain = chain.when(channel.contains("System") & (event_id == code), body)
    return chain.otherwise(text("Windows Event ", event_id.cast("string"), " from ", channel))


def payload_getter(payload: Column) -> Callable[[str], Column]:
    return lambda name: F.coalesce(payload[name], F.lit(""))


def source_info() -> Column:
    """`sourceInfo` of a section record, else the first of its `sources`."""
    first = F.get(parse_maps(F.col("rec")["sources"]), F.lit(0))
    return F.coalesce(parse_map(F.col("rec")["sourceInfo"]), first)


@builder("section.windowsEvent")
def section_events(df: DataFrame) -> DataFrame:
    """Pre-parsed Windows event records; only those of the system-API extractor."""
    info = F.col("_info")
    df = df.withColumn("_info", once(source_info()))
    named = F.coalesce(
        F.when(rec("logName") != "", rec("logName")),
        F.when(info["eventLogName"] != "", info["eventLogName"]),
        F.lit("Unknown"),
    )
    df = (
        df.where((rec("extractor") == "SystemAPI") | (info["extractor"] == "SystemAPI"))
        .withColumn("_eid", F.coalesce(whole_number(rec("eventID")).try_cast("int"), F.lit(0)))
        .withColumn("_named", named)
        .withColumn(
            "_channel",
            F.when(F.col("_named") == "Unknown", F.coalesce(labels.channel_of_event_id(F.col("_eid")), F.lit("Unknown")))
            .otherwise(F.col("_named")),
        )
        .withColumn("_payload", F.coalesce(parse_map(F.col("rec")["payload"]), F.expr("cast(map() as map<string,string>)")))
    )
    eid, channel = F.col("_eid"), F.col("_channel")
    record_id = F.coalesce(F.when(rec("recordID") != "", rec("recordID")), info["eventLogRecordId"])
    return build(
        df,
        Emit(
            event_type=category(eid, channel),
            data_type="windows:evtx:record",
            message=message(eid, channel, payload_getter(F.col("_payload"))),
            times=[(F.timestamp_millis(F.nullif(whole_number(rec("time")), F.lit(0))), "Windows Event Log Entry")],
            source=("CT-EventLog", F.concat(F.lit("SystemAPI - "), channel)),
            attrs={
                "source_name": labels.provider(channel), "channel": channel,
                "event_identifier": eid.cast("string"), "computer_name": F.col("host_name"),
                "record_number": record_id,
            },
            spread=F.col("_payload"),
        ),
    )


@builder("evtx")
def evtx_events(df: DataFrame) -> DataFrame:
    """Decoded event-log records (`file_time` ticks, `event_data` / `user_data`
    JSON): on a shared field name the event data wins. All fields are kept."""
    df = (
        df.withColumn("_eid", whole_number(rec("event_id")).try_cast("int"))
        .where(F.coalesce(F.col("_eid"), F.lit(0)) != 0)
        .withColumn("_event", _data_fields(F.col("rec")["event_data"]))
        .withColumn("_user", _inner_fields(F.col("rec")["user_data"]))
        .withColumn("_fields", overlay(F.col("_user"), F.col("_event")))
        .withColumn("_channel", F.when(rec("channel") != "", rec("channel")).otherwise(rec("file_channel")))
    )
    eid, channel = F.col("_eid"), F.col("_channel")
    return build(
        df,
        Emit(
            event_type=category(eid, channel),
            data_type="windows:evtx:record",
            message=message(eid, channel, payload_getter(F.col("_fields"))),
            times=[(filetime(rec("file_time")), "Event Log Entry")],
            source=("CT-EVTX", F.concat(F.lit("EVTX - "), channel)),
            attrs={
                "source_name": "provider", "channel": channel, "event_identifier": eid.cast("string"),
                "computer_name": F.when(rec("computer") != "", rec("computer")).otherwise(F.col("host_name")),
                "record_number": "record_id", "user_sid": "user_sid",
            },
            spread=F.col("_fields"),
            whole=F.when((eid == 4104) & F.col("_fields")["ScriptBlockText"].isNotNull(), F.col("_fields")["ScriptBlockText"]),
        ),
    )


def _no_markup(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.startswith("#") & ~k.startswith("@") & (k != "xmlns"))


def _empty_map() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def _data_fields(data: Column) -> Column:
    """Event data: plain fields, nested objects one level down, and the
    `Data` list of name/value items."""
    top = F.coalesce(_no_markup(parse_map(data)), _empty_map())
    plain = F.map_filter(top, lambda k, v: (k != "Data") & ~v.startswith("{"))
    nested = F.flatten(
        F.transform(
            F.map_entries(F.map_filter(top, lambda k, v: (k != "Data") & v.startswith("{"))),
            lambda e: F.map_entries(_no_markup(flatten_one_level(parse_map(e["value"])))),
        )
    )
    listed = F.coalesce(parse_maps(top["Data"]), F.array(parse_map(top["Data"])))
    items = F.transform(
        F.filter(listed, lambda m: m.isNotNull()),
        lambda m: F.struct(
            F.coalesce(F.when(m["@Name"] != "", m["@Name"]), m["Name"]).alias("key"),
            F.coalesce(F.when(m["#text"] != "", m["#text"]), m["Value"]).alias("value"),
        ),
    )
    items = F.filter(items, lambda e: e["key"] != "")
    return overlay(overlay(plain, F.map_from_entries(nested)), F.map_from_entries(items))


def _inner_fields(data: Column) -> Column:
    """User data: the fields of each nested object."""
    top = F.coalesce(_no_markup(parse_map(data)), _empty_map())
    nested = F.flatten(
        F.transform(
            F.map_entries(F.map_filter(top, lambda _, v: v.startswith("{"))),
            lambda e: F.map_entries(_no_markup(parse_map(e["value"]))),
        )
    )
    return F.map_from_entries(nested)
