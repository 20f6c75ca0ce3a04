"""Builders for Linux captures.

Line-oriented inputs come as line frames (`file`, `line_no`, `line`, `mtime`
where the file's own time matters); JSON inputs as record frames (`rec`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.values import real_number, whole_number
from siftline.functions.text import base_name, ellipsis, one_line, redact_secret, split_host_port
from siftline.functions.times import epoch_seconds, event_time, login_list_date, unix_micros, webkit_micros
from siftline.operators.build import Emit, build, build_all, builder, collected, opt, rec, say
from siftline.operators.lines import as_record, blocks, whitespace_fields
from siftline.operators.live import connection_kind

SHORT = "Collector-Linux"


def _source(part: Column | str) -> tuple:
    lead = "Linux Collector - "
    return SHORT, (lead + part if isinstance(part, str) else F.concat(F.lit(lead), part))


def _content(df: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment."""
    return df.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))


def _records(df: DataFrame, names: list[str], parts: Column, at_least: int) -> DataFrame:
    return df.withColumn("_parts", parts).where(F.size("_parts") >= at_least).withColumn(
        "rec", as_record(names, F.col("_parts"))
    )


def _no_header(df: DataFrame, *starts: str) -> DataFrame:
    """Drop the heading, which can only be a file's first line."""
    text = F.trim("line")
    heading = F.lit(False)
    for s in starts:
        heading = heading | text.startswith(s)
    return df.where(~((F.col("line_no") == 1) & heading) & (text != ""))


# ------------------------------------------------------------------ processes

@builder("linux.processes")
def processes(df: DataFrame) -> DataFrame:
    shown = F.coalesce(*[F.when(rec(n) != "", rec(n)) for n in ("cmdline", "exe", "name")], F.lit(""))
    base = F.when(rec("exe") != "", base_name(rec("exe"))).otherwise(rec("name"))

    def first_word(name: str) -> Column:
        return F.regexp_extract(rec(name), r"^([^ \t]*)", 1)

    return build(df, Emit(
        where=rec("pid") != "",
        event_type="running_process", data_type="linux:process:running",
        message=say("Running: {b} (PID:{pid}) {d}", b=base, d=ellipsis(shown, 200)), whole=shown,
        times=[
            (event_time(rec("collection_timestamp")), "Collection Time (Process Running)"),
            (collected(), "Collection Time (Process Running)"),
        ],
        source=_source("/proc snapshot"),
        attrs={
            "process_name": base, "process_path": "exe", "command_line": "cmdline", "pid": "pid", "ppid": "ppid",
            "uid": first_word("uid"), "gid": first_word("gid"), "state": "state", "cwd": "cwd", "root": "root",
            "name": "name",
        },
    ))


# -------------------------------------------------------------------- network

def _connection(protocol: Column, state: Column, local: Column, remote: Column, udp_text: str, part: str, **more) -> Emit:
    (lip, lport), (rip, rport) = split_host_port(local), split_host_port(remote)
    kind = connection_kind(protocol.startswith("udp"), state == "LISTEN")
    text = (
        F.when(kind == "udpListener", say(udp_text, l=lip, p=lport, s=state))
        .when(kind == "listeningPort", say("Listening: {n} {l}:{p}", n=protocol, l=lip, p=lport))
        .otherwise(say("Connected: {l}:{p} -> {r}:{q} [{s}]", l=lip, p=lport, r=rip, q=rport, s=state))
    )
    return Emit(
        event_type="active_connection", data_type="linux:network:connection",
        message=F.concat(text, more.pop("tail", F.lit(""))),
        times=[(collected(), "Collection Time (Connection Active)")],
        source=_source(part),
        attrs={
            "connection_type": kind, "protocol": protocol, "local_ip": lip, "local_port": lport,
            "remote_ip": rip, "remote_port": rport, "state": state,
        } | more,
    )


@builder("linux.sockets")
def sockets(df: DataFrame) -> DataFrame:
    """Socket list with process info in its last column."""
    df = _records(
        _no_header(df, "Netid", "State"), ["netid", "state", "recvq", "sendq", "local", "peer", "process"],
        whitespace_fields(7), 5,
    )
    pid = F.regexp_extract(rec("process"), r"pid=(\d+)", 1)
    name = F.regexp_extract(rec("process"), r'"([^"]+)",pid=', 1)
    tail = F.when(name != "", F.concat(say(" ({n}", n=name), opt(" PID:{p}", p=pid), F.lit(")"))).otherwise(F.lit(""))
    return build(df, _connection(
        rec("netid"), rec("state"), rec("local"), rec("peer"), "UDP Socket: {l}:{p} [{s}]", "ss -tunap",
        tail=tail, pid=pid, process_name=name,
    ))


@builder("linux.netstat")
def netstat(df: DataFrame) -> DataFrame:
    df = _records(df, ["proto", "recvq", "sendq", "local", "remote", "state"], whitespace_fields(), 4)
    df = df.where(rec("proto").rlike("^(tcp|udp)"))
    return build(df, _connection(
        rec("proto"), rec("state"), rec("local"), rec("remote"), "UDP Listener: {l}:{p}", "netstat",
    ))


def sockets_or_netstat(socket_lines: DataFrame, netstat_lines: DataFrame) -> DataFrame:
    """Netstat rows only for captures whose socket list gave no events."""
    first = sockets(socket_lines)
    rest = netstat(netstat_lines)
    have = first.select("upload_id").distinct()
    return first.unionByName(rest.join(have, "upload_id", "left_anti").select(*first.columns))


# ------------------------------------------------------------------- firewall

@builder("linux.firewall")
def firewall(df: DataFrame) -> DataFrame:
    """Whole rule sets (`rec`: label, text) -> one event each, and one per
    appended rule of the two line-based formats."""
    body = F.trim(rec("text"))
    whole = Emit(
        where=body != "",
        event_type="firewall_rule", data_type="linux:firewall:ruleset",
        message=say("{label} ruleset captured ({n} bytes): {p}", n=F.octet_length(body), p=one_line(body)),
        times=[(collected(), "Collection Time (Firewall Rule)")],
        source=_source(rec("label")),
        attrs={"setting": "label", "group": F.lit("Firewall"), "detail": body},
    )
    rules = df.where(rec("label").isin("iptables", "ip6tables")).withColumn(
        "line", F.explode(F.split(rec("text"), "\n"))
    ).withColumn("line", F.trim("line"))
    single = Emit(
        where=F.col("line").startswith("-A "),
        event_type="firewall_rule", data_type="linux:firewall:rule",
        message=say("{label} rule: {r}", r=ellipsis(F.col("line"), 200)), whole=F.col("line"),
        times=[(collected(), "Collection Time (Firewall Rule)")],
        source=_source(rec("label")),
        attrs={"setting": "label", "rule": F.col("line")},
    )
    return build(df, whole).unionByName(build(rules, single))


# ---------------------------------------------------------------- system info

# Keys of the system snapshot and their labels.
SYSTEM_KEYS = {
    "uname_-a": "Kernel", "uptime": "Uptime", "timedatectl": "TimeDate", "locale": "Locale",
    "who_-a": "LoggedUsers", "hostname": "Hostname",
}


def key_labels(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """Bag record -> one row per known non-empty key with `label`, `group`, `value`."""
    items = F.array(*[
        F.struct(F.lit(l).alias("label"), F.lit(g).alias("group"), F.trim(rec(k)).alias("value"))
        for k, (l, g) in labels.items()
    ])
    return df.withColumn("_i", F.explode(items)).where(F.col("_i.value") != "")


def setting_event(lead: str, data_type: str, source: tuple) -> Emit:
    label, group, value = F.col("_i.label"), F.col("_i.group"), F.col("_i.value")
    return Emit(
        event_type="os_config", data_type=data_type,
        message=say(lead + ": {l} = {v}", l=label, v=one_line(value)),
        times=[(collected(), "Collection Time (OS Configuration)")],
        source=source,
        attrs={"setting": label, "value": one_line(value), "group": group, "detail": value},
    )


@builder("linux.system_info")
def system_info(df: DataFrame) -> DataFrame:
    df = key_labels(df, {k: (v, "System") for k, v in SYSTEM_KEYS.items()})
    return build(df, setting_event("System", "linux:os:config_setting", _source("SystemInfo")))


# ------------------------------------------------------------------- packages

def _package(manager: str, message: Column, data_type: str, **attrs) -> Emit:
    return Emit(
        event_type="installed_program", data_type=data_type, message=message,
        times=[(collected(), "Collection Time (Program Installed)")],
        source=_source(manager), attrs=attrs | {"source": F.lit(manager)},
    )


@builder("linux.packages")
def packages(df: DataFrame) -> DataFrame:
    """Package listings as line frames with a `manager` column."""
    text = F.trim("line")
    df = df.where(text != "")
    tabs = F.split(text, "\t")
    names = {"program_name": "name", "version": "version"}

    def of(*managers: str) -> DataFrame:
        return df.where(F.col("manager").isin(*managers))

    dpkg = _records(of("dpkg"), ["name", "version", "arch", "status"], tabs, 2).where(rec("status").contains("installed"))
    rpm = _records(of("rpm"), ["name", "version", "arch", "install", "vendor"], tabs, 2)
    snap = _records(_no_header(of("snap"), "Name ", "Name\t"), ["name", "version"], whitespace_fields(), 2)
    parts = [
        build(dpkg, _package(
            "dpkg", say("Installed Package (dpkg): {name} v{version} [{arch}]"), "linux:pkg:dpkg",
            **names, architecture="arch", status="status",
        )),
        build(rpm, _package(
            "rpm", say("Installed Package (rpm): {name} v{version} [{arch}]"), "linux:pkg:rpm",
            **names, architecture="arch", install_time="install", vendor="vendor",
        )),
        build(snap, _package("snap", say("Installed Package (snap): {name} v{version}"), "linux:pkg:snap", **names)),
    ]
    for manager in ("pacman", "apk", "flatpak"):
        plain = _records(of(manager), ["name", "version"], whitespace_fields(), 1)
        parts.append(build(plain, _package(
            manager, say(f"Installed Package ({manager}): {{name}} {{version}}"), f"linux:pkg:{manager}", **names,
        )))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ accounts, logons

@builder("linux.passwd")
def passwd(df: DataFrame) -> DataFrame:
    df = _records(
        _content(df), ["user", "pw", "uid", "gid", "gecos", "home", "shell"], F.split(F.trim("line"), ":", 7), 7
    )
    system = F.coalesce(whole_number(rec("uid")).try_cast("int") < 1000, F.lit(False))
    return build(df, Emit(
        event_type="account_created", data_type="linux:user:account",
        message=F.concat(
            say("User account: {user}"), opt(" ({gecos})"), F.when(system, F.lit(" [system]")).otherwise(F.lit(""))
        ),
        times=[(collected(), "Account Created/Modified")],
        source=_source("/etc/passwd"),
        attrs={
            "username": "user", "full_name": "gecos", "uid": "uid", "gid": "gid", "home_dir": "home",
            "shell": "shell", "system_user": system,
        },
    ))


@builder("linux.logons")
def logons(df: DataFrame) -> DataFrame:
    """Login lists as line frames; `source` is `last` or `lastb` (failed)."""
    text = F.trim("line")
    df = df.where((text != "") & ~text.startswith("wtmp") & ~text.startswith("btmp"))
    df = df.withColumn("_parts", whitespace_fields()).where(F.size("_parts") >= 8)
    df = df.withColumn("rec", as_record(["user", "tty", "from"], F.col("_parts")))
    failed = F.col("source") == "lastb"
    desc = F.when(failed, F.lit("Failed Logon Recorded")).otherwise(F.lit("Logon Recorded"))
    return build(df, Emit(
        event_type=F.when(failed, F.lit("logon_failed")).otherwise(F.lit("logon_success")),
        data_type="linux:auth:wtmp_entry",
        message=say("Logon: user={user} tty={tty} from={from}"),
        times=[(login_list_date(F.array_join(F.slice("_parts", 4, 5), " ")), desc), (collected(), desc)],
        source=_source(F.col("source")),
        attrs={
            "username": "user", "terminal": "tty", "source_ip": "from", "raw_line": F.col("line"),
            "source": F.col("source"),
        },
    ))


# Phrases of the SSH daemon that decide the event type.
SSH_CLASSES = [
    (["Accepted password", "Accepted publickey"], "logon_success", "SSH Logon Success"),
    (["Failed password", "authentication failure", "Invalid user"], "logon_failed", "SSH Logon Failed"),
    (["session opened", "session closed"], "logon_session", "SSH Session Event"),
]


def ssh_class(text: Column) -> tuple[Column, Column]:
    """(event type, description) of an SSH daemon message."""
    kind, desc = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for phrases, k, d in SSH_CLASSES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        kind, desc = kind.when(hit, F.lit(k)), desc.when(hit, F.lit(d))
    return kind.otherwise(F.lit("auth_log")), desc.otherwise(F.lit("SSHD Log Entry"))


@builder("linux.sshd_journal")
def sshd_journal(df: DataFrame) -> DataFrame:
    """Journal records. The base fields stay authoritative; the full message
    is kept as the attribute `message`."""
    kind, desc = ssh_class(rec("MESSAGE"))
    return build(df, Emit(
        where=rec("MESSAGE") != "",
        event_type=kind, data_type="linux:auth:sshd",
        message=say("sshd[{_PID}]: {m}", m=one_line(rec("MESSAGE"))),
        times=[(unix_micros(rec("__REALTIME_TIMESTAMP")), desc)],
        source=_source("journal_sshd"),
        attrs={
            "message": "MESSAGE", "pid": "_PID", "unit": "_SYSTEMD_UNIT", "comm": "_COMM",
            "host_name": "_HOSTNAME", "source": F.lit("journal_sshd"),
        },
    ))


# ---------------------------------------------------------------- file records

def two_times(first: str, second: str) -> list[tuple]:
    """A configuration file is reported at its own time and at collection."""
    return [(F.col("mtime"), first), (collected(), second)]


# Unit kinds that count as start-up items.
UNIT_KINDS = ["service", "timer", "socket", "target", "path", "mount", "automount"]


@builder("linux.units")
def units(df: DataFrame) -> DataFrame:
    """Catalogue rows (`rel`, `size`, `mtime`) of captured unit files."""
    name = base_name(F.col("rel"))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    label = F.regexp_replace(name, r"\.[^.]*$", "")
    return build(df, Emit(
        fan_out=True, where=kind.isin(UNIT_KINDS),
        event_type="startup_item", data_type="linux:systemd:unit",
        message=F.concat(F.lit("Systemd "), kind, F.lit(": "), label),
        times=two_times("Unit File Modified", "Collection Time (Service Configuration)"),
        source=_source("systemd"),
        attrs={
            "config_type": F.lit("systemd"), "description": label, "location": F.concat(F.lit("/"), F.col("rel")),
            "unit_type": kind, "file_size": F.col("size"), "artifact_path": F.concat(F.lit("systemd/"), F.col("rel")),
        },
    ))


def persistence_category(rel: Column) -> Column:
    def ends(*tails: str) -> Column:
        hit = F.lit(False)
        for t in tails:
            hit = hit | rel.endswith(t)
        return hit

    return (
        F.when(ends("rc.local", "ld.so.preload"), F.lit("system_init"))
        .when(ends(".bashrc", ".zshrc", ".profile", ".bash_profile", ".zprofile"), F.lit("shell_init"))
        .when(rel.contains("autostart"), F.lit("desktop_autostart"))
        .when(ends(".service", ".timer"), F.lit("systemd"))
        .otherwise(F.lit("persistence"))
    )


@builder("linux.persistence")
def persistence(df: DataFrame) -> DataFrame:
    rel = F.col("rel")
    origin = F.when(
        rel.rlike("^users/[^/]+/."), F.concat(F.lit("/home/"), F.regexp_replace(rel, "^users/", ""))
    ).otherwise(F.concat(F.lit("/etc/"), rel))
    kind = persistence_category(rel)
    return build(df, Emit(
        fan_out=True,
        event_type="startup_item", data_type="linux:persistence:file",
        message=F.concat(F.lit("Persistence ("), kind, F.lit("): "), origin),
        times=two_times("File Modified", "Collection Time (Persistence Configured)"),
        source=_source("Persistence"),
        attrs={
            "config_type": F.lit("Persistence"), "description": base_name(origin), "location": origin,
            "category": kind, "file_size": F.col("size"),
            "artifact_path": F.concat(F.lit("persistence/"), rel),
        },
    ))


@builder("linux.cron_files")
def cron_files(df: DataFrame) -> DataFrame:
    origin = F.concat(F.lit("/etc/"), F.col("rel"))
    return build(df, Emit(
        event_type="scheduled_task", data_type="linux:cron:file",
        message=F.concat(F.lit("Crontab modified: "), origin),
        times=[(F.col("mtime"), "Crontab Modified")],
        source=_source("cron"),
        attrs={
            "config_type": F.lit("cron"), "location": origin, "file_size": F.col("size"),
            "artifact_path": F.concat(F.lit("cron/"), F.col("rel")),
        },
    ))


@builder("linux.cron_lines")
def cron_lines(df: DataFrame) -> DataFrame:
    """Crontab lines; settings such as `SHELL=/bin/sh` are not entries."""
    origin, text = F.concat(F.lit("/etc/"), F.col("rel")), F.trim("line")
    return build(_content(df), Emit(
        where=~(text.contains("=") & ~text.rlike("[ \t]")),
        event_type="scheduled_task", data_type="linux:cron:entry",
        message=F.concat(F.lit("Cron entry: "), ellipsis(text, 200)), whole=text,
        times=[(collected(), "Collection Time (Scheduled Task)")],
        source=_source("cron"),
        attrs={
            "config_type": F.lit("cron"), "location": origin, "line": F.col("line_no"), "raw": text,
            "crontab_file": base_name(origin),
        },
    ))


# ------------------------------------------------------------------------ SSH

def ssh_specs(data_prefix: str, source: tuple, with_user: bool = True) -> dict[str, Emit]:
    """Emits for key lines, known-host lines and configuration files."""
    user = F.regexp_extract(F.col("rel"), "^users/([^/]+)/", 1) if with_user else F.lit("")
    tail = opt(" (user: {u})", u=user)
    return {
        "keys": Emit(
            event_type="ssh_authorized_key", data_type=f"{data_prefix}:ssh:authorized_key",
            message=F.concat(say("SSH authorized_key: {type} {comment}"), tail),
            times=[(F.col("mtime"), "SSH Authorized Key Added")], source=source,
            attrs={"user_id": user, "key_type": "type", "key_comment": "comment", "key_data": "data"},
        ),
        "hosts": Emit(
            event_type="ssh_known_host", data_type=f"{data_prefix}:ssh:known_host",
            message=F.concat(say("SSH known_host: {host} ({type})"), tail),
            times=[(F.col("mtime"), "SSH Known Host Recorded")], source=source,
            attrs={"user_id": user, "host": "host", "key_type": "type"},
        ),
        "config": Emit(
            event_type="os_config", data_type=f"{data_prefix}:os:config_setting",
            message=F.concat(F.lit("SSH config file: "), F.lower(base_name(F.col("rel"))), tail),
            times=[(F.col("mtime"), "SSH Config Modified")], source=source,
            attrs={
                "setting": F.lit("ssh_config"), "file_name": base_name(F.col("rel")), "user_id": user,
                "file_size": F.col("size"),
            },
        ),
    }


def key_lines(df: DataFrame) -> DataFrame:
    parts = whitespace_fields()
    return _content(df).withColumn("_parts", parts).where(F.size("_parts") >= 2).withColumn(
        "rec", F.create_map(
            F.lit("type"), F.get("_parts", F.lit(0)), F.lit("data"), F.get("_parts", F.lit(1)),
            F.lit("comment"), F.array_join(F.slice("_parts", F.lit(3), F.size("_parts")), " "),
        )
    )


def host_lines(df: DataFrame) -> DataFrame:
    return _records(_content(df), ["host", "type", "data"], whitespace_fields(), 3)


@builder("linux.ssh_keys")
def ssh_keys(df: DataFrame) -> DataFrame:
    return build(key_lines(df), ssh_specs("linux", _source("SSH"))["keys"])


@builder("linux.ssh_hosts")
def ssh_hosts(df: DataFrame) -> DataFrame:
    return build(host_lines(df), ssh_specs("linux", _source("SSH"))["hosts"])


@builder("linux.ssh_config")
def ssh_config(df: DataFrame) -> DataFrame:
    name = F.lower(base_name(F.col("rel")))
    wanted = name.startswith("sshd_config") | name.startswith("ssh_config") | (name == "config")
    return build(df.where(wanted), ssh_specs("linux", _source("SSH"))["config"])


# -------------------------------------------------------------- shell history

def history_commands(df: DataFrame) -> DataFrame:
    """History lines -> `cmd`, `at` (own time or NULL). Plain lines and the
    extended form `: <epoch>:<elapsed>;<command>`."""
    extended = r"^: ([^;:]*):[^;]*;"
    text = F.trim("line")
    marked = text.rlike(r"^: [^;]*;")
    return df.select(
        "*",
        F.when(marked, F.regexp_replace(text, r"^: [^;]*;", "")).otherwise(text).alias("cmd"),
        F.when(marked, epoch_seconds(F.trim(F.regexp_extract(text, extended, 1)))).alias("at"),
    ).where(F.col("cmd") != "")


def fish_commands(df: DataFrame) -> DataFrame:
    """Two-line records `- cmd:` / `when:`: a command's block runs to the next
    command; the block's last `when:` is its time."""
    text = F.trim("line")
    group = ["upload_id", "site_id", "host_name", "file"]
    marked = df.withColumn("_text", text).where(text.startswith("- cmd: ") | text.startswith("when: "))
    marked = blocks(marked, group, F.col("_text").startswith("- cmd: "))
    keep = [c for c in df.columns if c not in {*group, "line_no", "line"}]
    whens = F.when(F.col("_text").startswith("when: "), F.col("line_no"))
    return (
        marked.where(F.col("block").isNotNull())
        .groupBy(*group, "block")
        .agg(
            F.min_by("_text", "line_no").alias("_cmd"), F.max_by("_text", whens).alias("_when"),
            *[F.min_by(c, "line_no").alias(c) for c in keep],
        )
        .select(
            *group, *keep, F.col("block").alias("line_no"),
            F.expr("substring(_cmd, 8)").alias("cmd"),
            epoch_seconds(F.trim(F.expr("substring(_when, 7)"))).alias("at"),
        )
        .where(F.col("cmd") != "")
    )


def history_emit(data_type: str, source: tuple) -> Emit:
    user = F.regexp_extract(F.col("rel"), "^([^/]+)/", 1)
    cmd = F.col("cmd")
    return Emit(
        event_type="shell_command", data_type=data_type,
        message=F.concat(F.lit("Shell command: "), ellipsis(cmd, 200), opt(" (User: {u})", u=user)), whole=cmd,
        times=[(F.col("at"), "Shell Command Recorded"), (F.col("mtime"), "Shell Command Recorded")],
        source=source,
        attrs={"command": cmd, "user_id": user, "shell_file": base_name(F.col("rel")), "line": F.col("line_no")},
    )


@builder("linux.shell_history")
def shell_history(df: DataFrame) -> DataFrame:
    name = base_name(F.col("rel"))
    fish = (name == "fish_history") | name.endswith(".fish")
    df = df.withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    spec = history_emit("linux:shell:history", _source(name))
    return build(history_commands(df.where(~fish)), spec).unionByName(build(fish_commands(df.where(fish)), spec))


# --------------------------------------------------------------------- docker

@builder("linux.docker_containers")
def docker_containers(df: DataFrame) -> DataFrame:
    status = F.when(rec("Status") != "", rec("Status")).otherwise(rec("State"))
    return build(df, Emit(
        where=rec("ID") != "",
        event_type="docker_container", data_type="linux:docker:container",
        message=say("Docker container: {Names} ({i}) - {s}", i=F.substring(rec("ID"), 1, 12), s=status),
        times=[(collected(), "Docker Container")], source=_source("Docker"),
        attrs={
            "container_id": "ID", "container_name": "Names", "image": "Image", "command": "Command",
            "status": status, "ports": "Ports", "running_for": "RunningFor",
        },
    ))


@builder("linux.docker_images")
def docker_images(df: DataFrame) -> DataFrame:
    tag = F.when(~rec("Tag").isin("", "<none>"), say(":{Tag}")).otherwise(F.lit(""))
    return build(df, Emit(
        where=rec("ID") != "",
        event_type="docker_image", data_type="linux:docker:image",
        message=say("Docker image: {Repository}{t} ({i}) - {Size}", t=tag, i=F.substring(rec("ID"), 1, 12)),
        times=[(collected(), "Docker Image")], source=_source("Docker"),
        attrs={"image_id": "ID", "repository": "Repository", "tag": "Tag", "size": "Size", "created_at": "CreatedAt"},
    ))


@builder("linux.docker_networks")
def docker_networks(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        where=rec("ID") != "",
        event_type="docker_network", data_type="linux:docker:network",
        message=say("Docker network: {Name} ({i}) driver={Driver}", i=F.substring(rec("ID"), 1, 12)),
        times=[(collected(), "Docker Network")], source=_source("Docker"),
        attrs={"network_id": "ID", "name": "Name", "driver": "Driver", "scope": "Scope"},
    ))


@builder("linux.docker_volumes")
def docker_volumes(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        where=rec("Name") != "",
        event_type="docker_volume", data_type="linux:docker:volume",
        message=say("Docker volume: {Name} driver={Driver}"),
        times=[(collected(), "Docker Volume")], source=_source("Docker"),
        attrs={"name": "Name", "driver": "Driver", "mountpoint": "Mountpoint"},
    ))


@builder("linux.docker_info")
def docker_info(df: DataFrame) -> DataFrame:
    def whole(name: str) -> Column:
        return F.coalesce(real_number(rec(name)).try_cast("int"), F.lit(0))

    return build(df, Emit(
        where=rec("ServerVersion") != "",
        event_type="os_config", data_type="linux:docker:info",
        message=say(
            "Docker version {ServerVersion}: {c} containers, {i} images, driver={Driver}",
            c=whole("Containers"), i=whole("Images"),
        ),
        times=[(collected(), "Docker Info")], source=_source("Docker"),
        attrs={
            "setting": F.lit("docker_info"), "server_version": "ServerVersion", "containers": whole("Containers"),
            "images": whole("Images"), "driver": "Driver",
        },
    ))


# ------------------------------------------------------- mounts, modules, misc

@builder("linux.fstab")
def fstab(df: DataFrame) -> DataFrame:
    df = _records(_content(df), ["device", "mountpoint", "fstype", "options"], whitespace_fields(), 4)
    return build(df, Emit(
        event_type="mount_entry", data_type="linux:disk:mount",
        message=say("Mount: {device} -> {mountpoint} ({fstype})"),
        times=[(collected(), "Filesystem Mount")], source=_source("fstab"),
        attrs={n: n for n in ("device", "mountpoint", "fstype", "options")},
    ))


@builder("linux.exports")
def exports(df: DataFrame) -> DataFrame:
    return build(_content(df), Emit(
        event_type="nfs_export", data_type="linux:disk:nfs_export",
        message=F.concat(F.lit("NFS export: "), F.trim("line")),
        times=[(collected(), "NFS Export")], source=_source("exports"), attrs={"export": F.trim("line")},
    ))


@builder("linux.modules")
def modules(df: DataFrame) -> DataFrame:
    df = _records(_no_header(df, "Module"), ["name", "size", "uses", "by"], whitespace_fields(), 2)
    return build(df, Emit(
        event_type="kernel_module", data_type="linux:kernel:module",
        message=F.concat(say("Kernel module: {name} ({size} bytes)"), opt(" used by: {by}")),
        times=[(collected(), "Kernel Module Loaded")], source=_source("lsmod"),
        attrs={"module_name": "name", "size": "size", "used_by": "by"},
    ))


# Fixed value: one line of a long directory listing.
LONG_LISTING = r"^(-[rwxsStT-]+)\s+\d+\s+(\S+)\s+(\S+)\s+(\d+)\s+\S+\s+\d+\s+[\d:]+\s+(.+)$"


def _special_binaries(df: DataFrame, kind: str, detail: str) -> DataFrame:
    line = F.trim("line")
    df = df.where(line != "")
    listed = line.rlike(LONG_LISTING)

    def part(n: int) -> Column:
        return F.when(listed, F.regexp_extract(line, LONG_LISTING, n))

    path = F.when(listed, part(5)).otherwise(F.regexp_extract(line, r"(\S+)$", 1))
    extra = F.when(listed, say(detail, o=part(2), g=part(3), p=part(1))).otherwise(F.lit(""))
    return build(df, Emit(
        event_type=f"{kind.lower()}_binary", data_type=f"linux:security:{kind.lower()}",
        message=F.concat(F.lit(f"{kind} binary: "), path, extra),
        times=[(collected(), f"{kind} Binary Found")], source=_source("Security"),
        attrs={
            "path": path, "permissions": part(1), "owner": part(2), "group": part(3), "size": part(4),
            "raw": F.when(~listed, line),
        },
    ))


@builder("linux.suid")
def suid(df: DataFrame) -> DataFrame:
    return _special_binaries(df, "SUID", " (owner={o}, perms={p})")


@builder("linux.sgid")
def sgid(df: DataFrame) -> DataFrame:
    return _special_binaries(df, "SGID", " (group={g}, perms={p})")


@builder("linux.shared_memory")
def shared_memory(df: DataFrame) -> DataFrame:
    """Segment rows; heading and rule lines come before the first of them."""
    line = F.trim("line")
    heading = line.startswith("------") | line.startswith("key") | line.startswith("shmid") | line.contains("Shared Memory Segments")
    df = _records(
        df.where(~heading), ["key", "shmid", "owner", "perms", "bytes", "nattch"], whitespace_fields(), 6
    )
    return build(df, Emit(
        event_type="shared_memory", data_type="linux:memory:shm",
        message=say("Shared memory: {shmid} (owner={owner}, {bytes} bytes, {nattch} attached)"),
        times=[(collected(), "Shared Memory Segment")], source=_source("Security"),
        attrs={
            "key": "key", "shmid": "shmid", "owner": "owner", "permissions": "perms", "bytes": "bytes",
            "nattach": "nattch",
        },
    ))


@builder("linux.environment")
def environment(df: DataFrame) -> DataFrame:
    """`NAME=value` lines; values of secret-looking names are redacted."""
    line = F.trim("line")
    name = F.substring_index(line, "=", 1)
    whole = redact_secret(name, F.regexp_replace(line, "^[^=]*=", ""))
    value = ellipsis(whole, 200)
    return build(df, Emit(
        where=line.contains("="),
        event_type="os_config", data_type="linux:os:env_var",
        message=F.concat(F.lit("Environment: "), name, F.lit("="), value), whole=whole,
        times=[(collected(), "Environment Variable")], source=_source("env"),
        attrs={"setting": name, "value": value, "group": F.lit("Environment"), "var_name": name, "var_value": value, "whole_value": F.when(whole != value, whole)},
    ))


def _status(kind: str, label: str, setting: str, group: str, lead: str, desc: str) -> Emit:
    body = F.trim(rec("text"))
    shown = F.regexp_replace(body, "\n", "; ")
    return Emit(
        where=(rec("kind") == kind) & (body != ""),
        event_type="os_config", data_type=f"linux:os:{setting}",
        message=F.concat(F.lit(lead), ellipsis(shown, 200)), whole=shown,
        times=[(collected(), desc)], source=_source(label),
        attrs={"setting": F.lit(setting), "group": F.lit(group), "detail": body},
    )


@builder("linux.status_texts")
def status_texts(df: DataFrame) -> DataFrame:
    """Whole status outputs (`rec`: kind, text): limits and access control."""
    return build_all(df, [
        _status("ulimit", "ulimit", "ulimit", "Resource Limits", "Resource limits (ulimit): ", "Resource Limits"),
        _status("selinux", "SELinux", "selinux", "Security", "SELinux: ", "SELinux Status"),
        _status("apparmor", "AppArmor", "apparmor", "Security", "AppArmor: ", "AppArmor Status"),
    ])
