"""Builders for macOS captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.functions.text import base_name, ellipsis, one_line, split_host_port
from siftline.functions.times import epoch_seconds, event_time, history_date, mac_absolute
from siftline.functions.values import first_non_empty, loose_boolean, real_number, whole_number
from siftline.operators.build import Emit, build, builder, collected, opt, rec, say
from siftline.operators.lines import as_record, block_records, blocks, carry_forward, whitespace_fields
from siftline.operators.linux import (
    history_commands, history_emit, host_lines, key_labels, key_lines, setting_event, ssh_specs, two_times,
)
from siftline.operators.live import connection_kind

SHORT = "Collector-macOS"
FILE_KEYS = ["upload_id", "site_id", "host_name", "collection_ts", "file"]


def _source(part: Column | str) -> tuple:
    lead = "macOS Collector - "
    return SHORT, (lead + part if isinstance(part, str) else F.concat(F.lit(lead), part))


# ------------------------------------------------------- processes and network

PROCESS_COLUMNS = [
    "user_id", "pid", "cpu_percent", "mem_percent", "vsz_kb", "rss_kb", "tty", "stat", "started", "cpu_time", "cmd",
]


@builder("macos.processes")
def processes(df: DataFrame) -> DataFrame:
    df = df.where(~((F.col("line_no") == 1) & F.col("line").startswith("USER")))
    df = df.withColumn("_parts", whitespace_fields(11)).where(F.size("_parts") == 11)
    df = df.withColumn("rec", as_record(PROCESS_COLUMNS, F.col("_parts")))
    program = F.substring_index(rec("cmd"), " ", 1)
    plain = [n for n in PROCESS_COLUMNS if n not in ("cmd", "pid")]
    pid = whole_number(rec("pid")).try_cast("int")
    return build(df, Emit(
        where=F.coalesce(pid, F.lit(0)) != 0,
        event_type="running_process", data_type="darwin:process:running",
        message=say("Running: {b} (PID:{pid}) {c}", b=base_name(program), c=ellipsis(rec("cmd"), 120)), whole=rec("cmd"),
        times=[(collected(), "Collection Time (Process Running)")],
        source=_source("ps auxwwe"),
        attrs={"process_name": base_name(program), "process_path": program, "command_line": "cmd", "pid": "pid"}
        | {n: n for n in plain},
    ))


def _connection(protocol: Column, state: Column, ends: tuple, texts: dict[str, Column], part: str, **more) -> Emit:
    (lip, lport), (rip, rport) = ends
    kind = connection_kind(F.lower(protocol).startswith("udp"), state == "LISTEN")
    chain = F.when(kind == "udpListener", texts["udp"]).when(kind == "listeningPort", texts["listen"])
    return Emit(
        event_type="active_connection", data_type="darwin:network:connection",
        message=chain.otherwise(texts["else"]),
        times=[(collected(), "Collection Time (Connection Active)")], source=_source(part),
        attrs={
            "connection_type": kind, "protocol": protocol, "local_ip": lip, "local_port": lport,
            "remote_ip": rip, "remote_port": rport, "state": state,
        } | more,
    )


@builder("macos.netstat")
def netstat(df: DataFrame) -> DataFrame:
    df = df.withColumn("_parts", whitespace_fields()).where(F.size("_parts") >= 4)
    df = df.withColumn("rec", as_record(["proto", "recvq", "sendq", "local", "remote", "state"], F.col("_parts")))
    df = df.where(rec("proto").rlike("^(tcp|udp)"))
    ends = split_host_port(rec("local"), True), split_host_port(rec("remote"), True)
    (l, p), (r, q) = ends
    tail = opt(" [{state}]")
    return build(df, _connection(rec("proto"), rec("state"), ends, {
        "udp": F.concat(say("UDP Listener: {l}:{p}", l=l, p=p), tail),
        "listen": F.concat(say("Listening: {proto} {l}:{p}", l=l, p=p), tail),
        "else": F.concat(say("Connected: {l}:{p} -> {r}:{q}", l=l, p=p, r=r, q=q), tail),
    }, "netstat"))


@builder("macos.open_sockets")
def open_sockets(df: DataFrame) -> DataFrame:
    """Open-file listing of sockets: protocol, `local->remote`, `(STATE)`."""
    text = F.trim("line")
    pattern = r"^(\S+)\s+(\d+)\s+(\S+)\s+\S+\s+.*?\b(TCP|UDP)\s+(.+)$"
    name_state = F.regexp_extract(text, pattern, 5)
    state = F.regexp_extract(name_state, r"\(([^()]+)\)[^()]*$", 1)
    name = F.when(state != "", F.trim(F.regexp_replace(name_state, r"\([^(]*$", ""))).otherwise(name_state)
    local, remote = F.substring_index(name, "->", 1), F.when(name.contains("->"), F.regexp_replace(name, "^.*?->", "")).otherwise(F.lit(""))
    ends = split_host_port(local, True), split_host_port(remote, True)
    (l, p), (r, q) = ends
    cmd, pid, user, protocol = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3, 4)]
    df = df.where(~text.startswith("COMMAND") & text.rlike(pattern)).withColumn(
        "rec", F.expr("cast(map() as map<string,string>)")
    )
    tail = say(" ({c} PID:{i} {u})", c=cmd, i=pid, u=user)
    return build(df, _connection(protocol, state, ends, {
        "udp": F.concat(say("UDP Listener: {l}:{p}", l=l, p=p), tail),
        "listen": F.concat(say("Listening: TCP {l}:{p}", l=l, p=p), tail),
        "else": F.concat(say("Connected: {l}:{p} -> {r}:{q}", l=l, p=p, r=r, q=q), tail),
    }, "lsof -i", pid=pid, process_name=cmd, user_id=user))


# ------------------------------------------------------------------- firewall

@builder("macos.firewall")
def firewall(df: DataFrame) -> DataFrame:
    """Whole firewall texts (`rec`: key, text): global state and packet filter."""
    body = F.trim(rec("text"))
    state = Emit(
        where=(rec("key") == "alf_global") & (body != ""),
        event_type="os_config", data_type="darwin:os:config_setting",
        message=F.concat(F.lit("Application Firewall: "), one_line(body)),
        times=[(collected(), "Collection Time (OS Configuration)")], source=_source("Firewall State"),
        attrs={
            "setting": F.lit("ApplicationLevelFirewall"), "value": one_line(body), "group": F.lit("Firewall"),
            "detail": body,
        },
    )
    packets = Emit(
        where=rec("key").isin("pfctl_rules", "pfctl_info", "pfctl_all") & (body != ""),
        event_type="os_config", data_type="darwin:os:config_setting",
        message=say("pfctl {key} captured ({n} bytes)", n=F.octet_length(body)),
        times=[(collected(), "Collection Time (OS Configuration)")], source=_source("PF Firewall"),
        attrs={"setting": "key", "group": F.lit("Firewall"), "detail": body},
    )
    return build(df, state).unionByName(build(df, packets))


@builder("macos.firewall_apps")
def firewall_apps(df: DataFrame) -> DataFrame:
    """`n : path` lines, each followed by the rule in brackets."""
    text = F.trim("line")
    df = df.where((text != "") & ~text.startswith("Total number"))
    is_path = text.contains(" : ")
    app = F.struct(F.col("line_no"), F.trim(F.regexp_replace(text, "^.*? : ", "")).alias("path"))
    df = carry_forward(df, FILE_KEYS, "line_no", F.when(is_path, app), "_app")
    # Only the first line after a path is its rule.
    rules = (
        df.where(~is_path & F.col("_app").isNotNull())
        .groupBy(*FILE_KEYS, "_app")
        .agg(F.min_by(text, "line_no").alias("rule"), F.min("seq").alias("seq"))
        .withColumn("rec", F.create_map(
            F.lit("path"), F.col("_app.path"), F.lit("rule"), F.regexp_replace("rule", r"^[()]+|[()]+$", "")
        ))
    )
    return build(rules, Emit(
        event_type="firewall_rule", data_type="darwin:firewall:rule",
        message=say("Firewall rule: {path} -- {rule}"),
        times=[(collected(), "Collection Time (Firewall Rule)")], source=_source("Application Firewall"),
        attrs={"setting": F.lit("alf_listapps"), "app_path": "path", "rule": "rule"},
    ))


# ---------------------------------------------------------------- persistence

# Fields kept of a background-item record.
ITEM_FIELDS = [
    "Name", "Developer Name", "Type", "Flags", "Disposition", "Identifier", "URL", "Executable Path",
    "Generation", "Parent Identifier", "UUID",
]


@builder("macos.background_items")
def background_items(df: DataFrame) -> DataFrame:
    """Dump of background items: records start at ` #n:` lines."""
    df = blocks(df, FILE_KEYS, F.col("line").rlike(r"^\s*#\d+:\s*$"))
    # Lines before the first header form a record of their own.
    df = df.withColumn("block", F.coalesce("block", F.lit(0)))
    df = block_records(df, FILE_KEYS, ITEM_FIELDS).withColumn("seq", F.col("block").cast("long"))
    name = F.when(rec("Name") != "(null)", rec("Name"))
    label = F.coalesce(first_non_empty(name, rec("Identifier"), rec("Executable Path")), F.lit(""))
    return build(df, Emit(
        where=label != "",
        event_type="startup_item", data_type="darwin:btm:item",
        message=F.concat(F.lit("BTM persistence: "), label, opt(" ({Type})"), opt(" [{Disposition}]")),
        times=[(collected(), "Collection Time (Persistence Configured)")], source=_source("sfltool dumpbtm"),
        attrs={
            "config_type": F.lit("BackgroundTaskManagement"), "description": label, "details": "Executable Path",
            "location": "URL", "identifier": "Identifier", "developer": "Developer Name", "item_type": "Type",
            "disposition": "Disposition",
        },
    ))


def service_state(pid: Column, status: Column) -> Column:
    return (
        F.when(~status.isin("0", "-", ""), F.concat(F.lit("exited("), status, F.lit(")")))
        .when(~pid.isin("-", ""), F.lit("running"))
        .otherwise(F.lit("loaded"))
    )


@builder("macos.launchd_services")
def launchd_services(df: DataFrame) -> DataFrame:
    df = df.where(~((F.col("line_no") == 1) & F.trim("line").startswith("PID")))
    df = df.withColumn("_parts", whitespace_fields(3)).where(F.size("_parts") == 3)
    df = df.withColumn("rec", as_record(["pid", "status", "label"], F.col("_parts")))
    state = service_state(rec("pid"), rec("status"))
    return build(df, Emit(
        where=rec("label") != "",
        event_type="startup_item", data_type="darwin:launchd:service",
        message=say("launchd: {label} [{s}]", s=state),
        times=[(collected(), "Collection Time (Service Configuration)")], source=_source("launchctl list"),
        attrs={
            "config_type": F.lit("launchd"), "description": "label", "service_name": "label",
            "display_name": "label", "status": state, "pid": "pid", "exit_status": "status",
        },
    ))


@builder("macos.launch_plists")
def launch_plists(df: DataFrame) -> DataFrame:
    """Decoded property lists (`rec`) with `rel`, `size`, `mtime` of the file."""
    rel = F.col("rel")
    user_scope = rel.startswith("users/")
    deep = rel.rlike("^users/[^/]+/[^/]+/.")
    user = F.when(deep, F.regexp_extract(rel, "^users/([^/]+)/", 1)).otherwise(F.lit(""))
    origin = F.when(
        deep, F.concat(F.lit("/Users/"), user, F.lit("/Library/"), F.regexp_replace(rel, "^users/[^/]+/", ""))
    ).otherwise(F.concat(F.lit("/"), rel))
    label = F.when(rec("Label") != "", rec("Label")).otherwise(F.regexp_replace(base_name(rel), r"\.[^.]*$", ""))
    args = F.from_json(rec("ProgramArguments"), "array<string>")
    program = F.coalesce(first_non_empty(rec("Program"), F.get(args, F.lit(0))), F.lit(""))
    every = whole_number(rec("StartInterval"))
    watched = F.from_json(rec("WatchPaths"), "array<string>")
    trigger = (
        F.when(loose_boolean(rec("KeepAlive")), F.lit("keepAlive"))
        .when(every > 0, F.concat(F.lit("interval="), every.cast("string"), F.lit("s")))
        .when(rec("StartCalendarInterval") != "", F.lit("calendar"))
        .when(F.size(watched) > 0, F.lit("watchPaths"))
        .otherwise(F.lit("load"))
    )
    return build(df.where(F.lower(rel).endswith(".plist")), Emit(
        fan_out=True,
        event_type="startup_item", data_type="darwin:launchd:plist",
        message=F.concat(F.lit("LaunchAgent/Daemon: "), label, F.lit(" -> "), program),
        times=two_times("Plist Modified", "Collection Time (Persistence Configured)"),
        source=_source("LaunchAgents/Daemons"),
        attrs={
            "config_type": F.lit("LaunchAgentDaemon"), "description": label, "label": label, "program": "Program",
            "executable": program, "arguments": "ProgramArguments", "run_at_load": loose_boolean(rec("RunAtLoad")),
            "keep_alive": loose_boolean(rec("KeepAlive")), "disabled": loose_boolean(rec("Disabled")),
            "watch_paths": "WatchPaths", "start_interval": "StartInterval",
            "start_calendar": "StartCalendarInterval", "working_dir": "WorkingDirectory",
            "environment": "EnvironmentVariables", "plist_path": origin, "plist_size": F.col("size"),
            "location": origin, "scope": F.when(user_scope, F.lit("user")).otherwise(F.lit("system")),
            "username": user, "trigger": trigger, "artifact_path": F.concat(F.lit("launch/"), rel),
        },
    ))


def persistence_category(rel: Column) -> Column:
    return (
        F.when(rel.contains("Extensions"), F.lit("kext_or_systemextension"))
        .when(rel.contains("cron") | rel.startswith("var/at"), F.lit("cron"))
        .when(rel.rlike(r"(rc|profile|rc\.common|rc\.local)$"), F.lit("shell_init"))
        .when(rel.contains("loginwindow"), F.lit("login_hooks"))
        .otherwise(F.lit("persistence"))
    )


@builder("macos.persistence")
def persistence(df: DataFrame) -> DataFrame:
    rel = F.col("rel")
    origin = F.when(
        rel.rlike("^users/[^/]+/."), F.concat(F.lit("/Users/"), F.regexp_replace(rel, "^users/", ""))
    ).otherwise(F.concat(F.lit("/"), rel))
    kind = persistence_category(rel)
    return build(df, Emit(
        fan_out=True,
        event_type="startup_item", data_type="darwin:persistence:file",
        message=F.concat(F.lit("Persistence ("), kind, F.lit("): "), origin),
        times=two_times("File Modified", "Collection Time (Persistence Configured)"),
        source=_source("Persistence"),
        attrs={
            "config_type": F.lit("Persistence"), "description": base_name(origin), "details": origin,
            "location": origin, "category": kind, "file_size": F.col("size"),
            "artifact_path": F.concat(F.lit("persistence/"), rel),
        },
    ))


# ------------------------------------------------------------------- programs

@builder("macos.app_bundles")
def app_bundles(df: DataFrame) -> DataFrame:
    rel = F.col("rel")
    app = F.regexp_extract(rel, r"(?:^|/)([^/]*)\.app(?:/|$)", 1)
    name = F.when(app != "", app).otherwise(F.lit("Info"))
    origin = F.concat(F.lit("/"), rel)
    return build(df.where(F.lower(base_name(rel)) == "info.plist"), Emit(
        event_type="installed_program", data_type="darwin:application:bundle",
        message=F.concat(F.lit("Installed Application: "), name),
        times=[(F.col("mtime"), "Application Bundle Modified")], source=_source("Applications"),
        attrs={
            "program_name": name, "install_path": origin, "info_plist": origin, "plist_size": F.col("size"),
            "artifact_path": F.concat(F.lit("applications/"), rel),
        },
    ))


@builder("macos.receipts")
def receipts(df: DataFrame) -> DataFrame:
    name = F.trim("line")
    return build(df.where(name != ""), Emit(
        event_type="installed_program", data_type="darwin:pkg:pkgutil",
        message=F.concat(F.lit("pkgutil package: "), name),
        times=[(collected(), "Collection Time (Package Installed)")], source=_source("pkgutil"),
        attrs={"program_name": name, "package_id": name, "source": F.lit("pkgutil")},
    ))


@builder("macos.install_history")
def install_history(df: DataFrame) -> DataFrame:
    """Indent blocks: a name at four blanks, its fields at six."""
    df = df.where(F.trim("line") != "")
    header = F.col("line").rlike(r"^ {4}\S.*:\s*$")
    df = blocks(df, FILE_KEYS, header)
    name = F.regexp_replace(F.trim("line"), ":$", "")
    as_pairs = df.withColumn(
        "line", F.when(header, F.concat(F.lit("Program:"), name)).when(F.col("line").rlike("^ {6}"), F.col("line"))
    ).where(F.col("line").isNotNull())
    df = block_records(as_pairs, FILE_KEYS, ["Program", "Version", "Source", "Install Date"])
    df = df.withColumn("seq", F.col("block").cast("long"))
    return build(df, Emit(
        where=rec("Program") != "",
        event_type="installed_program", data_type="darwin:install_history:entry",
        message=F.concat(say("Installed Program: {Program}"), opt(" v{Version}"), opt(" ({Source})")),
        times=[
            (history_date(rec("Install Date")), "Program Install Date"),
            (collected(), "Collection Time (Program Installed)"),
        ],
        source=_source("InstallHistory"),
        attrs={"program_name": "Program", "version": "Version", "source": "Source", "install_date": "Install Date"},
    ))


@builder("macos.users")
def users(df: DataFrame) -> DataFrame:
    """Directory dump: blank-line blocks of `key: value`."""
    df = blocks(df, FILE_KEYS, F.trim("line") == "").withColumn("block", F.coalesce("block", F.lit(0)))
    df = block_records(df, FILE_KEYS, ["name", "uid", "shell", "dir", "gecos"])
    df = df.withColumn("seq", F.col("block").cast("long"))
    system = F.coalesce(whole_number(rec("uid")).try_cast("int") < 500, F.lit(False))
    return build(df, Emit(
        where=rec("name") != "",
        event_type="account_created", data_type="darwin:user:account",
        message=F.concat(
            say("User account: {name}"), opt(" ({gecos})"), F.when(system, F.lit(" [system]")).otherwise(F.lit(""))
        ),
        times=[(collected(), "Account Created/Modified")], source=_source("dscacheutil"),
        attrs={
            "username": "name", "full_name": "gecos", "uid": "uid", "home_dir": "dir", "shell": "shell",
            "system_user": system,
        },
    ))


@builder("macos.shell_history")
def shell_history(df: DataFrame) -> DataFrame:
    df = df.withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    return build(history_commands(df), history_emit("darwin:shell:history", _source(base_name(F.col("rel")))))


@builder("macos.ssh_keys")
def ssh_keys(df: DataFrame) -> DataFrame:
    return build(key_lines(df), ssh_specs("darwin", _source("SSH"))["keys"])


@builder("macos.ssh_hosts")
def ssh_hosts(df: DataFrame) -> DataFrame:
    return build(host_lines(df), ssh_specs("darwin", _source("SSH"))["hosts"])


@builder("macos.ssh_config")
def ssh_config(df: DataFrame) -> DataFrame:
    name = F.lower(base_name(F.col("rel")))
    wanted = name.startswith("ssh_config") | name.startswith("sshd_config") | (name == "config")
    return build(df.where(wanted), ssh_specs("darwin", _source("SSH"))["config"])


@builder("macos.recent_items")
def recent_items(df: DataFrame) -> DataFrame:
    rel = F.col("rel")
    user = F.regexp_extract(rel, "^users/([^/]+)/", 1)
    return build(df, Emit(
        event_type="file_access", data_type="darwin:recent_items:file",
        message=F.concat(F.lit("Recent items file: "), base_name(rel), opt(" (user: {u})", u=user)),
        times=[(F.col("mtime"), "Recent Items Modified")], source=_source("Recent Items"),
        attrs={
            "file_path": rel, "file_name": base_name(rel), "file_size": F.col("size"), "user_id": user,
            "artifact_path": F.concat(F.lit("recent_items/"), rel),
        },
    ))


# Keys of the system snapshot.
SYSTEM_KEYS = {
    "csrutil_status": ("SIP", "Security"), "gatekeeper_status": ("Gatekeeper", "Security"),
    "filevault_status": ("FileVault", "Security"), "sw_vers": ("OS Version", "System"), "uname": ("Kernel", "System"),
}


@builder("macos.system_info")
def system_info(df: DataFrame) -> DataFrame:
    return build(
        key_labels(df, SYSTEM_KEYS), setting_event("System", "darwin:os:config_setting", _source("SystemInfo"))
    )


@builder("macos.backups")
def backups(df: DataFrame) -> DataFrame:
    df = key_labels(df, {k: (k, "Backup") for k in ("destinationinfo", "latestbackup", "status")})
    key, value = F.col("_i.label"), F.col("_i.value")
    return build(df, Emit(
        event_type="os_config", data_type="darwin:os:config_setting",
        message=say("Time Machine {k}: {v}", k=key, v=one_line(value)),
        times=[(collected(), "Collection Time (Backup Configuration)")], source=_source("Time Machine"),
        attrs={
            "setting": F.concat(F.lit("TimeMachine_"), key), "value": one_line(value), "group": F.lit("Backup"),
            "detail": value,
        },
    ))


# ----------------------------------------------------------- decoded databases

@builder("macos.usage_streams")
def usage_streams(df: DataFrame) -> DataFrame:
    """Usage objects of the known streams: start else creation time; lock and
    backlight rows take their event type from the state."""
    stream, on = rec("ZSTREAMNAME"), rec("ZVALUEINTEGER") == "1"
    kind, desc = labels.usage_stream(stream)

    def flag(name: str, yes: str, no: str) -> tuple:
        return stream == name, F.when(on, F.lit(yes)).otherwise(F.lit(no))

    locked, lock = flag("/device/isLocked", "locked", "unlocked")
    lit_, light = flag("/display/isBacklit", "on", "off")
    percent = F.coalesce(real_number(rec("ZVALUEDOUBLE")), F.lit(0.0)) * 100
    kind = F.when(locked, F.concat(F.lit("device_"), lock)).when(lit_, F.concat(F.lit("display_"), light)).otherwise(kind)
    text = (
        F.when(stream.isin("/app/usage", "/app/inFocus", "/app/intents", "/app/activity"), say("App used: {ZVALUESTRING}"))
        .when(locked, F.concat(F.lit("Device "), lock))
        .when(lit_, F.concat(F.lit("Display "), light))
        .when(stream == "/battery/percentage", F.format_string("Battery %.0f%%", percent))
        .when(stream == "/safari/history", say("Safari history: {ZVALUESTRING}"))
        .otherwise(say("{ZSTREAMNAME}: {ZVALUESTRING}"))
    )

    def stamp(name: str) -> Column:
        return F.when(real_number(rec(name)) > 0, mac_absolute(rec(name)))

    at = F.coalesce(stamp("ZSTARTDATE"), stamp("ZCREATIONDATE"), collected())
    return build(df, Emit(
        where=stream.isin(list(labels.USAGE_STREAMS)),
        event_type=kind, data_type=F.concat(F.lit("darwin:knowledgec:"), F.regexp_replace(stream, "^/", "")),
        message=text, times=[(at, desc)], source=_source("knowledgeC.db"),
        attrs={
            "stream": "ZSTREAMNAME", "value_string": "ZVALUESTRING", "value_int": "ZVALUEINTEGER",
            "value_double": "ZVALUEDOUBLE", "start_time": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            "end_time": F.date_format(stamp("ZENDDATE"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "scope": "scope",
            "username": "user",
        },
    ))


@builder("macos.permissions")
def permissions(df: DataFrame) -> DataFrame:
    service = F.regexp_replace(rec("service"), "^kTCC", "")
    granted = labels.permission_state(F.when(rec("auth_value") != "", rec("auth_value")))
    tail = F.when(rec("scope") == "user", opt(" (user {user})")).otherwise(F.lit(""))
    return build(df, Emit(
        event_type="tcc_grant", data_type="darwin:tcc:access",
        message=F.concat(say("TCC grant: {client} -> {s} = {g}", s=service, g=granted), tail),
        times=[(epoch_seconds(rec("last_modified")), "TCC Grant Modified"), (collected(), "TCC Grant Modified")],
        source=_source("TCC.db"),
        attrs={
            "setting": F.lit("tcc_grant"), "service": "service", "service_short": service, "client": "client",
            "client_type": "client_type", "auth_value": "auth_value", "auth_label": granted,
            "auth_reason": "auth_reason", "flags": "flags", "last_modified": "last_modified", "scope": "scope",
            "username": "user", "db_path": "db_path",
        },
    ))


@builder("macos.quarantine")
def quarantine(df: DataFrame) -> DataFrame:
    p = "LSQuarantine"
    return build(df, Emit(
        event_type="file_downloaded", data_type="darwin:quarantine:event",
        message=say("Download: {LSQuarantineDataURLString} (via {LSQuarantineAgentName})"),
        times=[
            (mac_absolute(rec(f"{p}TimeStamp")), "Quarantine: File Downloaded"),
            (collected(), "Quarantine: File Downloaded"),
        ],
        source=_source("QuarantineEventsV2"),
        attrs={
            "event_id": f"{p}EventIdentifier", "agent_name": f"{p}AgentName",
            "agent_bundle": f"{p}AgentBundleIdentifier", "data_url": f"{p}DataURLString",
            "origin_url": f"{p}OriginURLString", "origin_title": f"{p}OriginTitle",
            "sender_name": f"{p}SenderName", "sender_address": f"{p}SenderAddress",
            "type_number": f"{p}TypeNumber", "username": "user", "db_path": "db_path",
        },
    ))


@builder("macos.unified_log")
def unified_log(df: DataFrame) -> DataFrame:
    """Unified-log records in either key dialect. The base event type stays
    `os_log`; the record's own type is kept as the attribute `event_type`."""
    def pick(*names: str) -> Column:
        return F.coalesce(first_non_empty(*[rec(n) for n in names]), F.lit(""))

    stamp = pick("timestamp", "Timestamp", "datetime")
    text = pick("message", "eventMessage", "Message")
    process = pick("process", "processImagePath", "Process")
    subsystem = pick("subsystem", "Subsystem")
    at = F.when(stamp == "", collected()).otherwise(event_time(stamp))
    return build(df, Emit(
        where=(text != "") | (process != ""),
        event_type="os_log", data_type="darwin:unifiedlog:event",
        message=say("[{s}] {p}: {t}", s=subsystem, p=process, t=ellipsis(text, 1024)), whole=text,
        times=[(at, "Unified Log Event")], source=_source("UnifiedLog"),
        attrs={
            "subsystem": subsystem, "category": pick("category", "Category"), "process": process,
            "event_type": pick("eventType", "event_type", "logType", "level"),
            "trace_id": pick("traceID", "trace_id"), "raw_message": text,
        },
    ))
