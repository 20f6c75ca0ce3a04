"""Builders for the section records of a capture file (decoded JSON objects)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import ellipsis, human_cpu, human_bytes, human_duration, base_name, rid_of_sid
from siftline.functions.times import epoch_ms, event_time
from siftline.functions.labels import activity_description
from siftline.functions.values import analysis_attributes, first_non_empty, once, parse_map, parse_maps, whole_number
from siftline.operators.build import Emit, build, builder, collected, described, opt, rec, say, word
from siftline.operators.windows import source_info


def with_analysis(spec: Emit) -> Emit:
    """Add the joined analysis results of the record as attributes."""
    extra = analysis_attributes(F.col("rec")["analysisResults"])
    spec.attrs = spec.attrs | extra
    spec.significance = F.when(extra["ct_significance"] != "", extra["ct_significance"])
    return spec


def _info(df: DataFrame) -> DataFrame:
    return df.withColumn("_info", once(source_info()))


def info(name: str) -> Column:
    return F.coalesce(F.col("_info")[name], F.lit(""))


def _qualified(user: str, domain: str) -> Column:
    """`DOMAIN\\user`, or the user alone."""
    return F.concat(opt("{" + domain + "}\\"), rec(user))


def _by_user(user: str = "userID", domain: str = "userDomain") -> Column:
    return opt(" (User: {who})", who=F.when(rec(user) != "", _qualified(user, domain)))


def _sub_type(default: str) -> Column:
    return F.when(info("subType") != "", info("subType")).otherwise(F.lit(default))



def _program() -> Column:
    return F.when(rec("name") != "", rec("name")).otherwise(F.lit("unknown"))


def _extractor() -> Column:
    first = F.get(parse_maps(F.col("rec")["sources"]), F.lit(0))["sourceType"]
    return F.coalesce(
        F.when(rec("extractor") != "", rec("extractor")), F.when(info("extractor") != "", info("extractor")), first, F.lit("")
    )


@builder("section.process")
def processes(df: DataFrame) -> DataFrame:
    """Process records, routed by the extractor that wrote them."""
    df = _info(df).withColumn("_route", once(_extractor()))
    start = epoch_ms(rec("startTime"))
    common = {
        "process_name": _program(), "process_path": "path", "raw_path_data": "rawPathData",
        "command_line": "args", "ppid": "ppid", "parent_path": "parentPath", "user_id": "userID",
        "user_domain": "userDomain", "user_sid": "userSID", "elevated_admin": "elevatedAdminPriv",
        "is_service": "isService",
    }
    live = Emit(
        where=F.col("_route") == "LiveSnapshot",
        event_type="running_process", data_type="ct:memory:process",
        message=F.concat(
            say("Running: {n} (PID:{pid})", n=_program()), opt(" {a}", a=ellipsis(rec("args"), 100))
        ), whole=rec("args"),
        times=[(start, "Process Start Time"), (collected(), "Collection Time (Process Running)")],
        source=("CT-Memory", "SystemAPI - Running Processes"),
        attrs=common | {"pid": "pid"},
    )
    listed = Emit(
        where=F.col("_route") == "SystemAPI",
        event_type="session_logon", data_type="windows:tasks:job",
        message=F.concat(say("Process running: {n} (PID: {pid})", n=_program()), opt(" {args}")),
        times=[(start, "Process Start Time")],
        source=("CT-Memory", "SystemAPI - Process List"),
        attrs={
            "process_name": _program(), "process_path": "path", "pid": "pid",
            "command_line": "args", "user_id": "userID",
        },
    )
    gathered = Emit(
        where=~F.col("_route").isin("LiveSnapshot", "SystemAPI"),
        event_type="process_execution", data_type="windows:registry:userassist",
        message=F.concat(say("Program executed: {n}", n=_program()), opt(" {args}"), _by_user()),
        times=[(start, "Program Execution Time")],
        source=("CT-Registry", F.concat(F.lit("CollectionTool - "), _sub_type("Registry"))),
        attrs=common | {"observation_type": "observationType"},
    )
    out = [build(df, with_analysis(s)) for s in (live, listed, gathered)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@builder("section.configItem")
def config_items(df: DataFrame) -> DataFrame:
    kind = F.when(rec("type") != "", rec("type")).otherwise(F.lit("unknown"))
    return build(_info(df), with_analysis(Emit(
        event_type="startup_item", data_type="windows:registry:run",
        message=F.concat(say("Startup item configured: {k}", k=kind), opt(" - {description}"), opt(" ({args})")),
        times=[(epoch_ms(info("lastWriteTime")), "Registry Key Modified")],
        source=("CT-Registry", "CollectionTool - Startup Programs"),
        attrs={
            "config_type": kind, "description": "description", "details": "details", "arguments": "args",
            "user_id": "userID", "registry_key": info("keyName"), "registry_value": info("valueName"),
        },
    )))


@builder("section.logonData")
def remote_clients(df: DataFrame) -> DataFrame:
    """Remote-desktop client history of the registry."""
    who = F.when(rec("remoteUser") != "", _qualified("remoteUser", "remoteDomain"))
    return build(_info(df), with_analysis(Emit(
        event_type="rdp_connection", data_type="windows:registry:mstsc:connection",
        message=F.concat(say("RDP connection to {remoteHostName}"), opt(" as {who}", who=who)),
        times=[(epoch_ms(info("lastWriteTime")), "RDP Connection Time")],
        source=("CT-Registry", "CollectionTool - Terminal Server Client"),
        attrs={
            "entries": "remoteHostName", "username": "remoteUser", "key_path": info("keyName"),
            "remote_domain": "remoteDomain", "local_user": "userID", "user_sid": "userSID",
        },
    )))


@builder("section.userAccessedData")
def accessed_data(df: DataFrame) -> DataFrame:
    return build(_info(df), with_analysis(Emit(
        event_type="file_access", data_type="windows:registry:mrulist",
        message=F.concat(say("File accessed: {path}"), _by_user()),
        times=[(epoch_ms(rec("maxLastAccessDate")), "File Access Time")],
        source=("CT-Registry", F.concat(F.lit("CollectionTool - "), _sub_type("MRU"))),
        attrs={"file_path": "path", "user_id": "userID", "user_domain": "userDomain", "user_sid": "userSID"},
    )))


@builder("section.userAccount")
def accounts(df: DataFrame) -> DataFrame:
    admin = F.when(rec("adminPriv").isin("true", "domain"), F.lit(" [ADMIN]")).otherwise(F.lit(""))
    return build(df, with_analysis(Emit(
        event_type="account_created", data_type="windows:registry:sam_users",
        message=F.concat(
            say("User account: {u}", u=_qualified("userID", "userDomain")), opt(" ({accountType})"), admin
        ),
        times=[
            (epoch_ms(rec("dateCreated")), "Account Created/Modified"),
            (event_time(rec("lastLoginDate")), "Account Created/Modified"),
        ],
        source=("CT-SAM", "CollectionTool - User Account"),
        attrs={
            "username": "userID", "account_rid": rid_of_sid(rec("userSID")),
            "login_count": whole_number(rec("loginCount")).try_cast("int"), "user_domain": "userDomain",
            "user_sid": "userSID", "account_type": "accountType", "account_status": "accountStatus",
            "admin_priv": "adminPriv", "home_dir": "userHomeDir",
        },
    )))


@builder("section.nwConnectionDescriptor")
def connections(df: DataFrame) -> DataFrame:
    """Connection records, routed by the extractor that wrote them."""
    df = _info(df).withColumn("_route", once(_extractor()))
    seen = epoch_ms(rec("time"))
    ends = {
        "local_ip": "localIP", "local_port": "localPort", "remote_ip": "remoteIP", "remote_port": "remotePort",
        "pid": "pid", "state": "state", "direction": "direction", "local_host_name": "localHostName",
        "local_domain": "localDomain", "remote_domain": "remoteDomain", "remote_host_name": "remoteHostName",
    }
    protocol = F.when(rec("connectionType") != "", rec("connectionType")).otherwise(F.lit("TCP"))
    text = (
        F.when(rec("type") == "listeningPort", say("Listening: {p} {localIP}:{localPort}", p=protocol))
        .when(rec("type") == "establishedConnection", say("Connected: {localIP}:{localPort} -> {remoteIP}:{remotePort}"))
        .when(rec("type") == "udpListener", say("UDP Listener: {localIP}:{localPort}"))
        .otherwise(say("Network: {localIP}:{localPort} -> {remoteIP}:{remotePort}"))
    )
    active = Emit(
        where=F.col("_route") == "LiveSnapshot",
        event_type="active_connection", data_type="windows:network:connection",
        message=F.concat(text, opt(" (PID:{pid})")),
        times=[(seen, "Connection Time"), (collected(), "Collection Time (Connection Active)")],
        source=("CT-Memory", "SystemAPI - Network Connections"),
        attrs=ends | {"connection_type": "type", "protocol": protocol},
    )
    observed = Emit(
        where=F.col("_route") == "SystemAPI",
        event_type="network_connection", data_type="windows:network:connection",
        message=F.concat(
            say("Network connection: {localIP}:{localPort} → {remoteIP}:{remotePort}"), opt(" ({connectionType})")
        ),
        times=[(seen, "Connection Observed")],
        source=("CT-Memory", "SystemAPI - Network Connections"),
        attrs=ends | {"connection_type": "connectionType"},
    )
    mounted = Emit(
        where=~F.col("_route").isin("LiveSnapshot", "SystemAPI"),
        event_type="network_share", data_type="windows:registry:mountpoints2",
        message=say("Network share mounted: \\\\{remoteHostName}\\{remoteShareName}"),
        times=[(epoch_ms(info("lastWriteTime")), "Network Share Mount Time")],
        source=("CT-Registry", "CollectionTool - MountPoints2"),
        attrs={
            "remote_host_name": "remoteHostName", "remote_share_name": "remoteShareName",
            "user_id": "userID", "user_sid": "userSID",
        },
    )
    out = [build(df, with_analysis(s)) for s in (active, observed, mounted)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@builder("section.logonSession")
def logon_sessions(df: DataFrame) -> DataFrame:
    ip = first_non_empty(rec("remoteIP"), rec("sourceIP"))
    status = F.when(~rec("loginStatus").isin("", "success"), rec("loginStatus"))
    return build(df, with_analysis(Emit(
        event_type="logon_session", data_type="windows:logon:session",
        message=F.concat(
            say("Logon session: {u}", u=_qualified("userID", "userDomain")), opt(" from {ip}", ip=ip),
            opt(" (Type: {loginType})"), opt(" [{s}]", s=status),
        ),
        times=[
            (epoch_ms(rec("startTime")), "Logon Session Start"), (epoch_ms(rec("endTime")), "Logon Session End"),
        ],
        source=("CT-SystemAPI", "SystemAPI - Logon Sessions"),
        attrs={
            "user_id": "userID", "user_domain": "userDomain", "user_sid": "userSID", "remote_user": "remoteUser",
            "remote_domain": "remoteDomain", "remote_host_name": "remoteHostName", "remote_ip": "remoteIP",
            "source_ip": "sourceIP", "source_host_name": "sourceHostName", "destination_ip": "destinationIP",
            "destination_host": "destinationHostName", "local_ip": "localIP", "direction": "direction",
            "logon_type": "loginType", "logon_process": "logonProcess", "login_status": "loginStatus",
            "failure_reasons": "failureReasons",
        },
    )))


@builder("section.triggeredTask")
def triggered_tasks(df: DataFrame) -> DataFrame:
    name = F.when(rec("name") != "", rec("name")).otherwise(F.lit("Unknown Task"))
    steps = F.transform(
        F.filter(parse_maps(F.col("rec")["actions"]), lambda a: a["path"] != ""),
        lambda a: F.concat_ws(" ", a["path"], F.when(a["args"] != "", a["args"])),
    )
    return build(df, with_analysis(Emit(
        event_type="triggered_task", data_type="windows:tasks:job",
        message=F.concat(say("Scheduled Task: {n}", n=name), opt(" [{state}]"), opt(" (Run as: {userID})")),
        times=[(epoch_ms(rec("dateModified")), "Task Modified"), (epoch_ms(rec("dateCreated")), "Task Created")],
        source=("CT-CollectionTool", "CollectionTool - Scheduled Tasks"),
        attrs={
            "task_name": name, "task_state": "state", "description": "description", "triggers": "triggers",
            "actions": F.array_join(steps, "; "), "user_id": "userID", "user_domain": "userDomain",
            "user_sid": "userSID",
        },
    )))


@builder("section.webArtifact")
def web_artifacts(df: DataFrame) -> DataFrame:
    download = rec("type") == "DOWNLOAD"
    lead = F.when(download, F.lit("Download: ")).otherwise(F.lit("Visited: "))
    body = F.when(rec("title") != "", say("{title} ({url})")).otherwise(rec("url"))
    opened, made = epoch_ms(rec("dateAccessed")), epoch_ms(rec("dateCreated"))
    return build(df, with_analysis(Emit(
        event_type=F.when(download, F.lit("web_download")).otherwise(F.lit("web_visit")),
        data_type="ct:web:artifact",
        message=F.concat(lead, body, opt(" [{userID}]")),
        times=[
            (F.when(download, F.coalesce(opened, made)), "Web Download Time"),
            (opened, "Web Page Accessed"), (made, "Web Download Created"),
        ],
        source=("CT-WebArtifact", "Web Artifact"),
        attrs={
            "url": "url", "title": "title", "visit_type": "visitType", "referrer_url": "refURL",
            "remote_host_name": "remoteHostName", "visit_count": "visitCount", "local_path": "path",
            "query": "query", "artifact_type": "type", "user_id": "userID", "user_sid": "userSID",
            "user_domain": "userDomain",
        },
    )))


@builder("section.attachedDevice")
def attached_devices(df: DataFrame) -> DataFrame:
    """Up to three events per device: first and last connection, disconnection."""
    device = F.concat(say("{busType} {vendorId}"), opt(" {productId}"), opt(" (S/N: {serialNum})"))
    return build(df, with_analysis(Emit(
        fan_out=True,
        event_type="attached_device", data_type="windows:registry:usbstor",
        message=F.concat(F.lit("Device "), word(), F.lit(": "), device),
        times=[
            (epoch_ms(rec("firstConnectTime")), "Device First Connected", "first connected"),
            (epoch_ms(rec("lastConnectTime")), "Device Last Connected", "last connected"),
            (epoch_ms(rec("lastDisconnectTime")), "Device Last Disconnected", "last disconnected"),
        ],
        source=("CT-CollectionTool", "CollectionTool - Attached Devices"),
        attrs={"bus_type": "busType", "vendor_id": "vendorId", "product_id": "productId", "serial_num": "serialNum"},
    )))


@builder("section.logLine")
def log_lines(df: DataFrame) -> DataFrame:
    event_id = F.coalesce(whole_number(rec("eventID")).try_cast("int"), F.lit(0)).cast("string")
    return build(df, with_analysis(Emit(
        event_type="log_line", data_type="ct:log:line",
        message=F.concat(say("Log: {logName} Event {e}", e=event_id), opt(" (User: {userID})")),
        times=[(epoch_ms(rec("time")), "Log Entry")],
        source=("CT-LogLine", "Parsed Log Entry"),
        attrs={
            "log_name": "logName", "log_path": "logPath", "event_id": event_id, "record_id": "recordID",
            "user_id": "userID", "user_domain": "userDomain", "user_sid": "userSID",
        },
        spread=F.coalesce(parse_map(F.col("rec")["payload"]), F.expr("cast(map() as map<string,string>)")),
    )))


@builder("section.osConfigSetting")
def os_settings(df: DataFrame) -> DataFrame:
    return build(_info(df), with_analysis(Emit(
        event_type="os_config", data_type="ct:os:config_setting",
        message=F.concat(say("OS Config: {setting}"), opt(" = {v}", v=ellipsis(rec("value"), 80))), whole=rec("value"),
        times=[
            (collected(), "Collection Time (OS Configuration)"),
            (epoch_ms(info("lastWriteTime")), "Collection Time (OS Configuration)"),
        ],
        source=("CT-CollectionTool", "CollectionTool - OS Configuration"),
        attrs={"setting": "setting", "value": "value", "group": "group"},
    )))


# Record kinds the reference defines without calling; kept as input shapes.

def _app() -> Column:
    return F.when(rec("application") != "", rec("application")).otherwise(F.lit("Unknown"))


@builder("amcache.entry")
def amcache_entries(df: DataFrame) -> DataFrame:
    name = F.coalesce(first_non_empty(rec("Name"), rec("key_name")), F.lit("unknown"))
    return build(df, Emit(
        event_type="amcache_entry", data_type="windows:registry:amcache",
        message=F.concat(
            say("Amcache: {n}", n=name), opt(" ({p})", p=first_non_empty(rec("Publisher"), rec("ProductName")))
        ),
        times=[(event_time(rec("link_date_iso")), "PE Link Date"), (event_time(rec("key_timestamp")), "Amcache Key Modified")],
        source=("CT-Amcache", "Amcache - Application Execution"),
        attrs={
            "sha1_hash": "sha1_hash", "file_path": first_non_empty(rec("LowerCaseLongPath"), rec("FullPath")),
            "file_name": first_non_empty(rec("Name"), rec("OriginalFileName")), "publisher": "Publisher",
            "product_name": "ProductName", "product_version": first_non_empty(rec("ProductVersion"), rec("Version")),
            "program_id": "ProgramId",
        },
    ))


@builder("amcache.program")
def installed_programs(df: DataFrame) -> DataFrame:
    name = F.coalesce(first_non_empty(rec("Name"), rec("key_name")), F.lit("Unknown Program"))
    return build(df, Emit(
        event_type="installed_program", data_type="windows:registry:amcache:inventory_application",
        message=F.concat(say("Installed Program: {n}", n=name), opt(" v{Version}"), opt(" by {Publisher}")),
        times=[(event_time(rec("install_date_iso")), "Program Install Date"), (event_time(rec("key_timestamp")), "Program Install Date")],
        source=("CT-Amcache", "Amcache - Installed Programs"),
        attrs={
            "program_name": name, "publisher": "Publisher", "version": "Version", "install_path": "RootDirPath",
            "uninstall_string": "UninstallString", "msi_product_code": "MsiProductCode", "program_id": "ProgramId",
        },
    ))


@builder("registry.task_cache")
def task_cache(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="scheduled_task", data_type="task_scheduler:task_cache:entry",
        message=say("Scheduled Task: {n}", n=first_non_empty(rec("task_name"), rec("task_identifier"))),
        times=[
            (event_time(rec("launch_time")), "Task Last Launch Time"),
            (event_time(rec("last_written_time")), "Task Cache Entry Modified"),
        ],
        source=("CT-Registry", "Registry - Task Scheduler Cache"),
        attrs={n: n for n in (
            "task_name", "task_identifier", "key_path", "last_written_time", "last_registered_time", "launch_time",
        )},
    ))


@builder("usage_record.application")
def usage_application(df: DataFrame) -> DataFrame:
    cycles = [F.coalesce(whole_number(rec(f"{g}_cycle_time")), F.lit(0)) for g in ("foreground", "background")]
    total = cycles[0] + cycles[1]
    return build(df, Emit(
        event_type="srum_application", data_type="windows:srum:application_usage",
        message=F.concat(say("SRUM: {a}", a=base_name(_app())), opt(" (CPU: {t})", t=F.when(total > 0, human_cpu(total)))),
        times=[(event_time(rec("timestamp")), "SRUM Application Usage Recorded")],
        source=("CT-SRUM", "SRUM - Application Resource Usage"),
        attrs={
            "application": _app(), "identifier": "auto_inc_id", "user_identifier": "user_sid",
            "foreground_cycle_time": cycles[0], "background_cycle_time": cycles[1],
        } | {n: n for n in (
            "foreground_bytes_read", "foreground_bytes_written", "background_bytes_read", "background_bytes_written",
        )},
    ))


@builder("usage_record.connectivity")
def usage_connectivity(df: DataFrame) -> DataFrame:
    link = F.when(rec("interface_type") != "", rec("interface_type")).otherwise(F.lit("Unknown"))
    seconds = F.coalesce(whole_number(rec("connected_time")), F.lit(0))
    return build(df, Emit(
        event_type="srum_network", data_type="windows:srum:network_connectivity",
        message=F.concat(
            say("SRUM Network: {a} via {l}", a=base_name(_app()), l=link),
            opt(" ({t} connected)", t=F.when(seconds > 0, human_duration(seconds, 0))),
        ),
        times=[(event_time(rec("timestamp")), "SRUM Network Connectivity Recorded")],
        source=("CT-SRUM", "SRUM - Network Connectivity"),
        attrs={
            "application": _app(), "identifier": "auto_inc_id", "interface_luid": "interface_luid",
            "connected_time": seconds, "user_identifier": "user_sid", "interface_type": link,
        },
    ))


@builder("usage_record.bytes")
def usage_bytes(df: DataFrame) -> DataFrame:
    got, sent = [F.coalesce(whole_number(rec(n)), F.lit(0)) for n in ("bytes_received", "bytes_sent")]
    return build(df, Emit(
        where=(got + sent) != 0,
        event_type="srum_network_data", data_type="windows:srum:network_usage",
        message=say("SRUM Data: {a} - In:{i} Out:{o}", a=base_name(_app()), i=human_bytes(got), o=human_bytes(sent)),
        times=[(event_time(rec("timestamp")), "SRUM Network Data Usage Recorded")],
        source=("CT-SRUM", "SRUM - Network Data Usage"),
        attrs={
            "application": _app(), "identifier": "auto_inc_id", "bytes_received": got, "bytes_sent": sent,
            "bytes_total": got + sent, "user_identifier": "user_sid",
        },
    ))


@builder("activity.record")
def activity_records(df: DataFrame) -> DataFrame:
    """Activity-timeline entries with decoded text timestamps."""
    kind = F.coalesce(whole_number(rec("activity_type")).try_cast("int"), F.lit(0))
    shown = F.coalesce(first_non_empty(rec("activity_type_str")), F.concat(F.lit("Type-"), kind.cast("string")))
    return build(df, Emit(
        event_type="timeline_activity", data_type="windows:timeline:generic",
        message=F.concat(say("Timeline: {k} - {a}", k=shown, a=_app()), opt(" ({tag})")),
        times=[(event_time(rec("timestamp")), activity_description(kind))],
        source=("CT-Timeline", "Windows Timeline"),
        attrs={
            "application": _app(), "package_identifier": "package_name", "activity_identifier": "activity_id",
            "activity_type": kind, "tag": "tag",
        },
    ))


@builder("activity.engaged")
def activity_engaged(df: DataFrame) -> DataFrame:
    seconds = F.coalesce(whole_number(rec("duration_seconds")), F.lit(0))
    return build(df, Emit(
        event_type="timeline_engaged", data_type="windows:timeline:user_engaged",
        message=F.concat(say("User Engaged: {a}", a=_app()), opt(" ({t})", t=F.when(seconds > 0, human_duration(seconds)))),
        times=[(event_time(rec("timestamp")), "User Engagement Started")],
        source=("CT-Timeline", "Windows Timeline - User Engaged"),
        attrs={"application": _app(), "package_identifier": "package_name", "active_duration_seconds": seconds},
    ))


@builder("access_log.client")
def client_access(df: DataFrame) -> DataFrame:
    address = F.when(rec("address") != "", rec("address")).otherwise(F.lit("Unknown"))
    role = F.when(rec("role_name") != "", rec("role_name")).otherwise(F.lit("Unknown Service"))
    total = F.coalesce(whole_number(rec("total_accesses")).try_cast("int"), F.lit(0))
    who = F.when(rec("username") == "", F.lit("Anonymous")).otherwise(F.substring_index(rec("username"), "\\", -1))
    return build(df, Emit(
        event_type="ual_client_access", data_type="windows:user_access_logging:clients",
        message=F.concat(
            say("UAL: {w} from {a} -> {r}", w=who, a=address, r=role),
            opt(" ({t} total accesses)", t=F.when(total > 1, total)),
        ),
        times=[(event_time(rec("timestamp")), "Client Access Recorded")],
        source=("CT-UAL", "User Access Logging - Clients"),
        attrs={
            "source_address": address, "username": "username", "client_name": "client_name",
            "role_identifier": "role_guid", "role_name": role, "access_count": total,
        },
    ))


@builder("access_log.dns")
def client_dns(df: DataFrame) -> DataFrame:
    client = F.when(rec("client_address") != "", rec("client_address")).otherwise(F.lit("Unknown"))
    host = F.when(rec("hostname") != "", rec("hostname")).otherwise(F.lit("Unknown"))
    return build(df, Emit(
        event_type="ual_dns_query", data_type="windows:user_access_logging:dns",
        message=say("DNS Query: {c} -> {h}", c=client, h=host),
        times=[(event_time(rec("timestamp")), "DNS Query Recorded")],
        source=("CT-UAL", "User Access Logging - DNS"),
        attrs={"client_address": client, "hostname": host},
    ))
