"""Remaining record kinds: usage tables, activities, server logs, cloud and mail
records, task definitions, command histories and repository text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.functions.text import human_bytes, human_duration, mac_address, printable, sid_of_path
from siftline.functions.times import event_time, ole_date, seconds_or_filetime
from siftline.functions.values import any_of, drop_empty, first_application, first_non_empty, flatten_one_level, real_number, whole_number
from siftline.operators.build import Emit, build, builder, collected, opt, rec, say

# ---------------------------------------------------------------- fixed values
SUSPICIOUS_COMMANDS = [
    "invoke-webrequest", "invoke-expression", "iex(", "iex ", "downloadstring", "downloadfile", "net.webclient",
    "start-bitstransfer", "certutil", "-encodedcommand", "bypass", "-nop", "-w hidden", "frombase64string",
    "invoke-mimikatz", "invoke-shellcode", "invoke-bloodhound", "new-object system.net", "reflection.assembly",
    "add-type", "compilerparameters",
]
REPOSITORY_PATTERNS = [
    "CommandLineEventConsumer", "ActiveScriptEventConsumer", "__EventFilter", "__FilterToConsumerBinding",
    "powershell", "cmd.exe", "wscript", "cscript", "mshta", "certutil", "bitsadmin",
]
CONTEXT_WIDTH = 200
# ------------------------------------------------------------ end fixed values


# ---------------------------------------------------------------- usage tables

def name_usage_ids(rows: DataFrame, ids: DataFrame, app_context: str = "App") -> DataFrame:
    """Add `app` and `user` names to usage rows; unknown ids are named
    `<context>-<id>` (connectivity rows use the context `Network`). `ids`:
    upload_id, id_index, name (one row per id)."""
    def named(df: DataFrame, field: str, out: str, context: str) -> DataFrame:
        key = F.coalesce(whole_number(rec(field)), F.lit(0))
        lookup = ids.select("upload_id", F.col("id_index").alias("_id"), F.col("name").alias("_name"))
        joined = df.withColumn("_id", key).join(lookup, ["upload_id", "_id"], "left")
        fallback = F.concat(F.lit(context), F.lit("-"), F.col("_id").cast("string"))
        return joined.withColumn(out, F.coalesce("_name", fallback)).drop("_id", "_name")

    return named(named(rows, "AppId", "app", app_context), "UserId", "user", "User")


def usage_stamp() -> Column:
    """Usage rows carry days since 1899-12-30, or an already decoded time."""
    text = rec("TimeStamp")
    ts = event_time(text)
    return F.coalesce(ole_date(text), F.when(F.year(ts).between(1970, 2100), ts))


def _count(name: str) -> Column:
    return F.coalesce(whole_number(rec(name)), F.lit(0))


def _usage(kind: str, event: str, desc: str, message: Column, **attrs) -> Emit:
    return Emit(
        event_type=event, data_type=f"windows:srum:{kind}", message=message, times=[(usage_stamp(), desc)],
        source=("CT-SRUM", f"SRUM - {kind.replace('_', ' ').title()}"),
        attrs={"application": F.col("app"), "user_sid": F.col("user")} | attrs,
    )


@builder("usage.application")
def usage_application(df: DataFrame) -> DataFrame:
    fg, bg = _count("ForegroundCycleTime"), _count("BackgroundCycleTime")
    return build(df, _usage(
        "application_usage", "srum_app_usage", "SRUM Application Usage",
        say("App usage: {a} (user: {u}, fg: {f}, bg: {b})", a=F.col("app"), u=F.col("user"), f=fg, b=bg),
        foreground_cycle_time=fg, background_cycle_time=bg,
    ))


@builder("usage.connectivity")
def usage_connectivity(df: DataFrame) -> DataFrame:
    seconds = _count("ConnectedTime")
    return build(df, _usage(
        "network_connectivity", "srum_network_connectivity", "SRUM Network Connectivity",
        say("Network connectivity: {a} (user: {u}, connected: {s}s)", a=F.col("app"), u=F.col("user"), s=seconds),
        connected_time=seconds,
    ))


@builder("usage.network")
def usage_network(df: DataFrame) -> DataFrame:
    got, sent = _count("BytesRecvd"), _count("BytesSent")
    return build(df, _usage(
        "network_usage", "srum_network_usage", "SRUM Network Usage",
        say(
            "Network usage: {a} (user: {u}, recv: {r}, sent: {s})", a=F.col("app"), u=F.col("user"),
            r=human_bytes(got), s=human_bytes(sent),
        ),
        bytes_received=got, bytes_sent=sent,
    ))


# ----------------------------------------------------------- activity timeline

def engaged_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between the two, never negative."""
    return F.when(end > start, F.floor(end - start)).otherwise(F.lit(0)).cast("long")


@builder("activity.table")
def activities(df: DataFrame) -> DataFrame:
    """Rows of the activity database; kind 6 is user engagement."""
    kind = F.coalesce(whole_number(rec("ActivityType")).try_cast("int"), F.lit(0))
    app = F.when(F.col("rec")["AppId"].isNull(), F.lit("Unknown")).otherwise(first_application(F.col("rec")["AppId"]))
    app = F.when(app == "", F.lit("Unknown")).otherwise(app)
    at = F.when(real_number(rec("LastModifiedTime")) > 0, seconds_or_filetime(rec("LastModifiedTime")))
    seconds = F.coalesce(
        engaged_seconds(real_number(rec("StartTime")), real_number(rec("EndTime"))), F.lit(0)
    )
    engaged = Emit(
        where=kind == 6,
        event_type="timeline_engaged", data_type="windows:timeline:user_engaged",
        message=F.concat(say("User Engaged: {a}", a=app), opt(" ({t})", t=F.when(seconds > 0, human_duration(seconds)))),
        times=[(at, "User Engagement Started")], source=("CT-Timeline", "Windows Timeline - User Engaged"),
        attrs={"application": app, "active_duration_seconds": seconds},
    )
    generic = Emit(
        where=kind != 6,
        event_type="timeline_activity", data_type="windows:timeline:generic",
        message=F.concat(say("Timeline: Type-{k} - {a}", k=kind, a=app), opt(" ({Tag})")),
        times=[(at, labels.activity_description(kind))], source=("CT-Timeline", "Windows Timeline"),
        attrs={"application": app, "activity_type": kind, "tag": "Tag"},
    )
    return build(df, engaged).unionByName(build(df, generic))


# --------------------------------------------------------- logs, cloud, mail

@builder("dhcp")
def dhcp(df: DataFrame) -> DataFrame:
    """Server log rows (`rec`: code, date, time, ip, host, mac, file). The date
    and time are joined as they stand and must already be ISO-like."""
    label = labels.dhcp_code(rec("code"))
    return build(df, Emit(
        event_type="dhcp_event", data_type="windows:dhcp:log",
        message=F.concat(say("DHCP: {d} - {ip}", d=label), opt(" ({host})")),
        times=[(_dhcp_time(), "DHCP Server Log Entry")], source=("CT-DHCP", "DHCP Server Log"),
        attrs={
            "event_id": "code", "description": label, "ip_address": "ip", "hostname": "host",
            "mac_address": mac_address(rec("mac")), "log_file": "file",
        },
    ))


def _dhcp_time() -> Column:
    joined = F.concat(rec("date"), F.lit("T"), rec("time"))
    return F.coalesce(event_time(joined), F.try_to_timestamp(joined, F.lit("MM/dd/yy'T'HH:mm:ss")))


@builder("mail")
def mail(df: DataFrame) -> DataFrame:
    """Mail-security export rows: URL clicks and mail events, by their columns."""
    clicks = Emit(
        where=F.map_contains_key(F.col("rec"), F.lit("ClickTime")),
        event_type="mdo_url_click", data_type="mdo:url_click",
        message=F.concat(say("MDO URL Click: {Url}"), opt(" [{ClickAction}]")),
        times=[(event_time(rec("ClickTime")), "MDO Event Time")], source=("CT-MDO", "Microsoft Defender for Office 365"),
        attrs={
            "url": "Url", "networkMessageId": "NetworkMessageId", "clickAction": "ClickAction",
            "urlChain": "UrlChain", "threats": "Threats",
        },
    )
    stamp = F.coalesce(first_non_empty(rec("Timestamp"), rec("ReceivedDate")), F.lit(""))
    mails = Emit(
        where=~F.map_contains_key(F.col("rec"), F.lit("ClickTime"))
        & F.map_contains_key(F.col("rec"), F.lit("NetworkMessageId")),
        event_type="mdo_email_event", data_type="mdo:email_event",
        message=say("MDO Email: {SenderAddress} -> {RecipientAddress}: {Subject}"),
        times=[(event_time(stamp), "MDO Event Time")], source=("CT-MDO", "Microsoft Defender for Office 365"),
        attrs={
            "senderAddress": "SenderAddress", "recipientAddress": "RecipientAddress", "subject": "Subject",
            "networkMessageId": "NetworkMessageId", "deliveryAction": "DeliveryAction", "threats": "Threats",
        },
    )
    return build(df, clicks).unionByName(build(df, mails))


@builder("cloud")
def cloud(df: DataFrame) -> DataFrame:
    """Cloud sign-in and audit records; an activity name makes it an audit."""
    audit = rec("activityDisplayName") != ""
    source = F.when(audit, F.lit("Entra ID Audit")).otherwise(F.lit("Entra ID Sign-In"))
    stamp = F.coalesce(first_non_empty(rec("createdDateTime"), rec("activityDateTime")), F.lit(""))
    return build(df, Emit(
        event_type=F.when(audit, F.lit("entra_audit")).otherwise(F.lit("entra_signin")),
        data_type=F.when(audit, F.lit("entra:audit")).otherwise(F.lit("entra:signin")),
        message=F.concat(
            say("Entra: {userPrincipalName} -> {appDisplayName}"), opt(" from {ipAddress}"), opt(" ({resourceDisplayName})")
        ),
        times=[(event_time(stamp), F.concat(source, F.lit(" Event")))], source=("CT-Entra", source),
        spread=flatten_one_level(drop_empty(F.col("rec"))),
    ))


@builder("task_xml")
def task_definitions(df: DataFrame) -> DataFrame:
    """Parsed task files (`rec`: date, author, description, uri, command,
    arguments, user_id, run_level, file_name, file_path)."""
    name = F.when(rec("uri") != "", rec("uri")).otherwise(F.regexp_replace(rec("file_name"), r"\.xml$", ""))
    command = F.when(rec("command") != "", F.concat(rec("command"), opt(" {arguments}"))).otherwise(F.lit(""))
    return build(df, Emit(
        event_type="scheduled_task_xml", data_type="windows:tasks:job",
        message=F.concat(say("Scheduled Task: {n}", n=name), opt(" -> {c}", c=command)),
        times=[(event_time(rec("date")), "Task Registration Date")], source=("CT-Tasks", "Scheduled Tasks"),
        attrs={
            "task_name": name, "author": "author", "description": "description", "command": command,
            "user_id": "user_id", "run_level": "run_level", "file_path": say("{file_path}/{file_name}"),
        },
    ))


# ------------------------------------------------------ histories, repository

def suspicious_command(line: Column) -> Column:
    text = F.lower(line)
    return any_of([text.contains(t) for t in SUSPICIOUS_COMMANDS])


@builder("powershell_history")
def powershell_history(df: DataFrame) -> DataFrame:
    """History lines (line frame with `rel`), reported at collection time."""
    line = F.trim("line")
    odd = suspicious_command(line)
    df = df.where(line != "").withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    return build(df, Emit(
        event_type="powershell_history", data_type="windows:powershell:history",
        message=F.concat(F.lit("PS> "), line),
        times=[(collected(), "PowerShell History (Collection Time)")], source=("CT-PowerShell", "PowerShell History"),
        attrs={
            "command": line, "line_number": F.col("line_no"), "history_file": F.col("rel"),
            "user_sid": sid_of_path(F.col("rel")), "is_suspicious": odd,
        },
        suspicious=odd,
    ))


def _overlaps_itself(pattern: str) -> bool:
    return any(pattern.startswith(pattern[i:]) for i in range(1, len(pattern)))


def occurrences(df: DataFrame, text: Column, patterns: list[str], width: int = CONTEXT_WIDTH, block: int = 1 << 20) -> DataFrame:
    """Every occurrence of each literal pattern in the whole text: `pattern`, `offset`
    (0-based) and `context` of ±`width` characters.

    The text is cut into blocks of characters, each with a margin of its neighbours,
    so what goes on is no more than the text once. One pattern of all alternatives then
    cuts a block where an occurrence begins, and the context is taken there, before rows
    multiply. Nothing is shuffled. A pattern that may overlap itself would need what
    stands before the block; such patterns are refused.
    """
    if wrong := [p for p in patterns if not p or _overlaps_itself(p)]:
        raise ValueError(f"patterns that are empty or overlap themselves: {wrong}")
    longest = max(map(len, patterns))
    margin = max(width, longest)
    known = F.array(*map(F.lit, patterns))
    begins = "(?=" + "|".join(r"\Q" + p + r"\E" for p in patterns) + ")"

    def around(blocks: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            before, behind = F.when(i > 0, F.get(blocks, i - 1)), F.get(blocks, i + 1)
            lead = F.coalesce(F.substring(before, F.length(before) - margin + 1, F.lit(margin)), F.lit(""))
            return F.struct((i.cast("long") * block).alias("base"), F.length(lead).alias("lead"), F.length(piece).alias("size"),
                            F.concat(lead, piece, F.coalesce(F.substring(behind, F.lit(1), F.lit(margin)), F.lit(""))).alias("text"))
        return F.transform(blocks, one)

    def hits(b: Column) -> Column:
        pieces = F.split(b["text"], begins, -1)
        starts = F.aggregate(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["all"], acc["at"] + F.length(p)).alias("all")),
            lambda acc: acc["all"])
        # Java finds nothing before a first occurrence at the very start.
        starts = F.when(b["text"].rlike("^" + begins), F.array_union(F.array(F.lit(0)), starts)).otherwise(starts)
        own = F.filter(starts, lambda o: (o >= b["lead"]) & (o < b["lead"] + b["size"]))

        def here(o: Column) -> Column:
            begin = F.greatest(o - width, F.lit(0))
            told = printable(F.substring(b["text"], begin + 1, o + width - begin))
            found = F.filter(known, lambda p: F.startswith(F.substring(b["text"], o + 1, F.lit(longest)), p))
            return F.transform(found, lambda p: F.struct(p.alias("pattern"), (b["base"] + o - b["lead"]).alias("offset"), told.alias("context")))

        return F.flatten(F.transform(own, here))

    # Texts without any of the patterns go no further.
    some = df.withColumn("_text", text).where(F.col("_text").rlike("|".join(r"\Q" + p + r"\E" for p in patterns)))
    whole = some.withColumn("_blocks", F.regexp_extract_all("_text", F.lit("(?s).{1,%d}" % block), 0)).drop("_text")
    blocks = whole.select(*df.columns, F.explode(around(F.col("_blocks"))).alias("_block"))
    return blocks.withColumn("_hits", hits(F.col("_block"))).drop("_block").select(*df.columns, F.inline("_hits"))


@builder("wmi_repository")
def repository_keywords(df: DataFrame) -> DataFrame:
    """Persistence keywords in repository text (`rec`: text, file)."""
    df = occurrences(df, rec("text"), REPOSITORY_PATTERNS)
    # Rows go on without the text.
    df = df.withColumn("rec", F.map_filter("rec", lambda k, _: k != "text"))
    return build(df, Emit(
        event_type="wmi_persistence", data_type="windows:wmi:persistence",
        message=F.concat(F.lit("WMI: "), F.col("pattern"), F.lit(" found in OBJECTS.DATA")),
        times=[(collected(), "WMI Repository Analysis (Collection Time)")], source=("CT-WMI", "WMI Repository"),
        attrs={"pattern": F.col("pattern"), "context": F.col("context"), "file": "file", "offset": F.col("offset")},
        whole=F.concat_ws("\u0000", rec("file"), "pattern", F.col("offset").cast("string")),
    ))
