"""Builders for the live-state snapshots of Windows captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import ellipsis, split_domain_user
from siftline.functions.times import event_time
from siftline.functions.values import loose_boolean, whole_number
from siftline.operators.build import Emit, build, builder, collected, opt, rec, say

SHORT = "Collector-Windows"


def _source(part: str) -> tuple[str, str]:
    return SHORT, f"Windows Collector - {part}"


def connection_kind(udp: Column, listening: Column) -> Column:
    """Connection class; the caller decides which test comes first."""
    return (
        F.when(udp, F.lit("udpListener")).when(listening, F.lit("listeningPort")).otherwise(F.lit("establishedConnection"))
    )


def live_connection_kind(protocol: Column, state: Column) -> Column:
    """Class in live snapshots, where listening is tested before UDP."""
    return (
        F.when(state.isin("LISTEN", "Listening"), F.lit("listeningPort"))
        .when(protocol == "UDP", F.lit("udpListener"))
        .otherwise(F.lit("establishedConnection"))
    )


@builder("live.processes")
def processes(df: DataFrame) -> DataFrame:
    name = F.when(rec("name") != "", rec("name")).otherwise(F.lit("unknown"))
    domain, user = split_domain_user(rec("user"))
    modules = F.from_json(rec("modules"), "array<string>")
    loaded = F.when(F.size(modules) > 50, F.concat(F.size(modules).cast("string"), F.lit(" modules loaded"))).otherwise(
        F.array_join(modules, "; ")
    )
    return build(df, Emit(
        event_type="running_process", data_type="ct:memory:process",
        message=F.concat(say("Running: {n} (PID:{pid})", n=name), opt(" {c}", c=ellipsis(rec("command_line"), 100))), whole=rec("command_line"),
        times=[
            (event_time(rec("start_time")), "Process Start Time"), (collected(), "Collection Time (Process Running)"),
        ],
        source=_source("Running Processes"),
        attrs={
            "process_name": name, "process_path": "path", "command_line": "command_line", "pid": "pid",
            "ppid": "ppid", "user_id": user, "user_domain": domain, "md5": "md5", "memory_mb": "memory_mb",
            "loaded_modules": loaded, "all_modules": F.when(F.size(modules) > 50, F.array_join(modules, "; ")),
        },
    ))


@builder("live.connections")
def connections(df: DataFrame) -> DataFrame:
    kind = live_connection_kind(rec("protocol"), rec("state"))
    text = (
        F.when(kind == "listeningPort", say("Listening: {protocol} {local_address}:{local_port}"))
        .when(kind == "udpListener", say("UDP Listener: {local_address}:{local_port}"))
        .otherwise(say("Connected: {local_address}:{local_port} -> {remote_address}:{remote_port}"))
    )
    pid = whole_number(rec("pid")).try_cast("int")
    return build(df, Emit(
        event_type="active_connection", data_type="windows:network:connection",
        message=F.concat(text, F.when(pid > 0, say(" (PID:{pid} {process_name})")).otherwise(F.lit(""))),
        times=[(collected(), "Collection Time (Connection Active)")],
        source=_source("Network Connections"),
        attrs={
            "connection_type": kind, "protocol": "protocol", "local_ip": "local_address",
            "local_port": "local_port", "remote_ip": "remote_address", "remote_port": "remote_port",
            "pid": "pid", "state": "state", "process_name": "process_name",
        },
    ))


@builder("live.dns_cache")
def dns_cache(df: DataFrame) -> DataFrame:
    answer = F.when(rec("data") != "", say(" -> {data}")).otherwise(F.lit(" (no data cached)"))
    return build(df, Emit(
        where=rec("name") != "",
        event_type="dns_cache_entry", data_type="ct:memory:dns_cache",
        message=F.concat(say("DNS Cache: {name}"), answer),
        times=[(collected(), "Collection Time (DNS Cache Snapshot)")],
        source=_source("DNS Cache"),
        attrs={"hostname": "name", "resolved_ip": "data", "record_type": "type", "ttl": "ttl"},
    ))


@builder("live.arp_cache")
def arp_cache(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        where=rec("ip_address") != "",
        event_type="arp_cache_entry", data_type="ct:memory:arp_cache",
        message=say("ARP Cache: {ip_address} -> {mac_address}"),
        times=[(collected(), "Collection Time (ARP Cache Snapshot)")],
        source=_source("ARP Cache"),
        attrs={"ip_address": "ip_address", "mac_address": "mac_address", "arp_type": "type"},
    ))


@builder("live.routing_table")
def routing_table(df: DataFrame) -> DataFrame:
    hop = F.when(~rec("gateway").isin("", "0.0.0.0"), say(" via {gateway}")).otherwise(F.lit(" (direct)"))
    return build(df, Emit(
        where=rec("destination") != "",
        event_type="routing_entry", data_type="ct:memory:routing_table",
        message=F.concat(say("Route: {destination}"), hop),
        times=[(collected(), "Collection Time (Routing Table Snapshot)")],
        source=_source("Routing Table"),
        attrs={
            "destination": "destination", "netmask": "netmask", "next_hop": "gateway",
            "interface_address": "interface_address", "metric": "metric",
        },
    ))


@builder("live.logon_sessions")
def logon_sessions(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="logon_session", data_type="windows:logon:session",
        message=F.concat(F.lit("Logon session: "), opt("{domain}\\"), rec("username"), opt(" (Type: {logon_type})")),
        times=[
            (event_time(rec("logon_time")), "Logon Session Start"),
            (collected(), "Collection Time (Logon Session Active)"),
        ],
        source=_source("Logon Sessions"),
        attrs={
            "user_id": "username", "user_domain": "domain", "user_sid": "sid", "logon_type": "logon_type",
            "logon_id": "logon_id", "auth_package": "auth_package",
        },
    ))


def account_status(disabled: Column, locked: Column) -> Column:
    return F.when(locked, F.lit("locked")).when(disabled, F.lit("disabled")).otherwise(F.lit("active"))


def is_admin(groups: Column) -> Column:
    return F.coalesce(F.exists(groups, lambda g: F.lower(g) == "administrators"), F.lit(False))


@builder("live.user_accounts")
def user_accounts(df: DataFrame) -> DataFrame:
    disabled, locked = loose_boolean(rec("is_disabled")), loose_boolean(rec("is_locked"))
    groups = F.from_json(rec("groups"), "array<string>")

    def mark(flag: Column, text: str) -> Column:
        return F.when(flag, F.lit(text)).otherwise(F.lit(""))

    return build(df, Emit(
        event_type="account_created", data_type="windows:registry:sam_users",
        message=F.concat(
            say("User account: {username}"), opt(" ({full_name})"), mark(disabled, " [DISABLED]"),
            mark(locked, " [LOCKED]"), mark(is_admin(groups), " [ADMIN]"),
        ),
        times=[(event_time(rec("last_logon")), "Account Created/Modified"), (collected(), "Account Created/Modified")],
        source=_source("User Accounts"),
        attrs={
            "username": "username", "full_name": "full_name", "user_sid": "sid",
            "account_status": account_status(disabled, locked),
            "admin_priv": F.when(is_admin(groups), F.lit("true")), "groups": F.array_join(groups, ", "),
            "password_last_set": "password_last_set",
        },
    ))


@builder("live.services")
def services(df: DataFrame) -> DataFrame:
    shown = F.when(rec("display_name") != rec("name"), rec("display_name"))
    return build(df, Emit(
        event_type="startup_item", data_type="windows:registry:run",
        message=F.concat(say("Service: {name}"), opt(" ({d})", d=shown), say(" [{status}]")),
        times=[(collected(), "Collection Time (Service Configuration)")],
        source=_source("Windows Services"),
        attrs={
            "config_type": F.lit("Service"), "description": "description", "details": "binary_path",
            "start_type": "start_type", "status": "status", "account": "account", "service_name": "name",
            "display_name": "display_name",
        },
    ))


@builder("live.startup_items")
def startup_items(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="startup_item", data_type="windows:registry:run",
        message=F.concat(say("Startup item: {name}"), opt(" ({c})", c=ellipsis(rec("command"), 80))), whole=rec("command"),
        times=[(collected(), "Collection Time (Startup Configuration)")],
        source=_source("Startup Items"),
        attrs={
            "config_type": F.lit("Startup"), "description": "name", "details": "command",
            "location": "location", "user_id": "user",
        },
    ))


@builder("live.devices")
def devices(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="attached_device", data_type="windows:registry:usbstor",
        message=F.concat(say("Device: {name}"), opt(" ({manufacturer})"), opt(" [S/N: {serial_number}]")),
        times=[(collected(), "Collection Time (Device Attached)")],
        source=_source("Attached Devices"),
        attrs={
            "device_name": "name", "device_id": "device_id", "manufacturer": "manufacturer", "status": "status",
            "class_name": "class_name", "serial_num": "serial_number",
        },
    ))


@builder("live.user_accessed_data")
def accessed_data(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="file_access", data_type="windows:registry:mrulist",
        message=F.concat(say("{type}: {path}"), opt(" (User: {user})")),
        times=[(event_time(rec("modified")), "File Access Time"), (collected(), "File Access Time")],
        source=_source("User Accessed Data"),
        attrs={
            "access_type": "type", "file_path": "path", "file_name": "name", "user_id": "user",
            "file_size": "size", "detail": "detail",
        },
    ))


@builder("live.os_config")
def os_config(df: DataFrame) -> DataFrame:
    return build(df, Emit(
        event_type="os_config", data_type="ct:os:config_setting",
        message=F.concat(say("OS Config: {name}"), opt(" = {v}", v=ellipsis(rec("value"), 80))), whole=rec("value"),
        times=[(collected(), "Collection Time (OS Configuration)")],
        source=_source("OS Configuration"),
        attrs={"setting": "name", "value": "value", "group": "category", "detail": "detail"},
    ))
