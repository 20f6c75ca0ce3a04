"""Builders for ESXi captures: dash tables (`rec` per row), whole texts, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import base_name, ellipsis, one_line, split_host_port
from siftline.functions.times import event_time
from siftline.functions.values import first_non_empty
from siftline.operators.build import Emit, build, builder, collected, opt, rec, say
from siftline.operators.lines import whitespace_fields
from siftline.operators.linux import key_lines, ssh_specs, two_times
from siftline.operators.live import connection_kind

SHORT = "Collector-ESXi"


def _source(part: Column | str) -> tuple:
    lead = "ESXi Collector - "
    return SHORT, (lead + part if isinstance(part, str) else F.concat(F.lit(lead), part))


def _pick(*names: str) -> Column:
    return F.coalesce(first_non_empty(*[rec(n) for n in names]), F.lit(""))


# Snapshot files and what they hold.
SYSTEM_FILES = {
    "uname.txt": ("Kernel", "System"), "vmware_version.txt": ("VMware Version", "System"),
    "esxcli_system_version.txt": ("ESXi Version", "System"), "esxcli_hostname.txt": ("Hostname", "System"),
    "esxcli_uuid.txt": ("Host UUID", "System"), "esxcli_boot_device.txt": ("Boot Device", "System"),
    "esxcli_maintenancemode.txt": ("MaintenanceMode", "System"),
    "esxcli_secureboot.txt": ("SecureBoot", "Security"),
    "esxcli_settings_advanced.txt": ("Advanced Settings", "System"),
    "esxcli_settings_kernel.txt": ("Kernel Settings", "System"), "timekeeping.txt": ("TimeKeeping", "System"),
    "uptime.txt": ("Uptime", "System"), "lockdown.txt": ("Lockdown Mode", "Security"),
}
SECURITY_FILES = {
    "secureboot.txt": "SecureBoot", "tpm.txt": "TPM", "keystore.txt": "KeyPersistence", "lockdown.txt": "Lockdown",
}


def _setting_files(df: DataFrame, labels: dict[str, tuple[str, str]], lead: str, part: str) -> DataFrame:
    """Whole small texts (`rec`: file, text) -> one setting event each."""
    pairs = F.create_map(*[
        c for k, (l, g) in labels.items() for c in (F.lit(k), F.struct(F.lit(l).alias("l"), F.lit(g).alias("g")))
    ])
    body = F.trim(rec("text"))
    df = df.withColumn("_l", pairs[rec("file")]).where(F.col("_l").isNotNull() & (body != ""))
    return build(df, Emit(
        event_type="os_config", data_type="esxi:os:config_setting",
        message=say(lead + ": {l} = {v}", l=F.col("_l.l"), v=one_line(body)),
        times=[(collected(), "Collection Time (OS Configuration)")], source=_source(part),
        attrs={"setting": F.col("_l.l"), "value": one_line(body), "group": F.col("_l.g"), "detail": body},
    ))


@builder("esxi.system_info")
def system_info(df: DataFrame) -> DataFrame:
    return _setting_files(df, SYSTEM_FILES, "System", "SystemInfo")


@builder("esxi.security")
def security(df: DataFrame) -> DataFrame:
    return _setting_files(df, {k: (v, "Security") for k, v in SECURITY_FILES.items()}, "Security", "Security")


def vm_inventory(lines: DataFrame, power: DataFrame | None = None) -> DataFrame:
    """VM list lines: id, name, `[store] path.vmx`, guest, version. `power`
    (upload_id, vm_id, power_state) adds the state where it was captured."""
    pattern = r"^(\d+)\s+(.*)$"
    text = F.trim("line")
    df = lines.where(text.rlike(pattern))
    rest = F.regexp_extract(text, pattern, 2)
    named = r"^(.*?)(\[.*?\.vmx)\s*(\S*)\s*(\S*)"
    vmx = rest.contains("[")

    def part(n: int) -> Column:
        return F.when(vmx, F.trim(F.regexp_extract(rest, named, n))).otherwise(F.lit(""))

    df = df.withColumn("_vm", F.regexp_extract(text, pattern, 1))
    if power is not None:
        df = df.join(power.select("upload_id", F.col("vm_id").alias("_vm"), "power_state"), ["upload_id", "_vm"], "left")
    else:
        df = df.withColumn("power_state", F.lit(None).cast("string"))
    name = F.when(vmx, F.trim(F.substring_index(rest, "[", 1))).otherwise(rest)
    df = df.withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    return build(df, Emit(
        event_type="vm_inventory", data_type="esxi:vm:inventory",
        message=F.concat(
            say("VM: {n} (Vmid:{i}) {g}", n=name, i=F.col("_vm"), g=part(3)), opt(" [{p}]", p=F.col("power_state"))
        ),
        times=[(collected(), "Collection Time (VM Inventory)")], source=_source("vmsvc/getallvms"),
        attrs={
            "vm_id": F.col("_vm"), "vm_name": name, "vmx_path": part(2), "guest_os": part(3), "version": part(4),
            "raw": text, "power_state": F.col("power_state"),
        },
    ))


builder("esxi.vm_list")(vm_inventory)


@builder("esxi.processes")
def processes(df: DataFrame) -> DataFrame:
    """Blank-line blocks of `Key: value`; `rec` holds one block's fields."""
    return build(df, Emit(
        where=rec("Name") != "",
        event_type="running_process", data_type="esxi:process:running",
        message=say("Running: {Name} (World:{World ID}) [{Type}]"),
        times=[(collected(), "Collection Time (Process Running)")], source=_source("esxcli system process list"),
        attrs={
            "process_name": "Name", "world_id": "World ID", "uid": "UID", "type": "Type", "service": "Service",
            "raw": "_raw",
        },
    ))


def key_value_blocks(texts: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line blocks of `Key: value` lines -> one `rec` per block. A listing
    is one row; its blocks are split and parsed in place, without a shuffle."""
    def pairs(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, "\r?\n"), F.trim), lambda r: F.instr(r, ":") > 1)
        entry = F.transform(
            rows,
            lambda r: F.struct(
                F.trim(F.substring_index(r, ":", 1)).alias("key"), F.trim(F.regexp_replace(r, "^[^:]*:", "")).alias("value")
            ),
        )
        keys = F.array_distinct(F.transform(entry, lambda e: e["key"]))
        return F.map_from_entries(
            F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entry, lambda e: e["key"] == k), -1)["value"]))
        )

    df = texts.select(
        *[c for c in texts.columns if c != text], F.posexplode(F.split(F.col(text), r"(?:\r?\n[ \t]*){2,}")).alias("block", "_b")
    ).where(F.trim("_b") != "")
    return df.withColumn("rec", F.map_concat(pairs(F.col("_b")), F.create_map(F.lit("_raw"), F.col("_b")))).drop("_b")


@builder("esxi.connections")
def connections(df: DataFrame) -> DataFrame:
    (l, p), (r, q) = split_host_port(rec("Local Address")), split_host_port(rec("Foreign Address"))
    kind = connection_kind(rec("Proto").startswith("udp"), rec("State") == "LISTEN")
    text = (
        F.when(kind == "udpListener", say("UDP Socket: {l}:{p}", l=l, p=p))
        .when(kind == "listeningPort", say("Listening: {Proto} {l}:{p}", l=l, p=p))
        .otherwise(say("Connected: {l}:{p} -> {r}:{q} [{State}]", l=l, p=p, r=r, q=q))
    )
    tail = F.when(
        rec("World Name") != "", F.concat(say(" ({World Name}"), opt(" World:{World ID}"), F.lit(")"))
    ).otherwise(F.lit(""))
    return build(df, Emit(
        where=rec("Proto") != "",
        event_type="active_connection", data_type="esxi:network:connection",
        message=F.concat(text, tail),
        times=[(collected(), "Collection Time (Connection Active)")],
        source=_source("esxcli network ip connection list"),
        attrs={
            "connection_type": kind, "protocol": "Proto", "local_ip": l, "local_port": p, "remote_ip": r,
            "remote_port": q, "state": "State", "world_id": "World ID", "process_name": "World Name",
        },
    ))


def _raw() -> Column:
    return F.to_json(F.col("rec"))


TABLE_KINDS = [
    "accounts", "permissions", "firewall_rulesets", "firewall_rules", "filesystems", "packages", "multipath_devices",
    "multipath_paths", "fc_adapters", "iscsi_adapters", "security_policies", "nics", "nics_v6", "port_groups",
    "wbem_config", "wbem_providers", "cpus", "pci_devices",
]


def _table_emits() -> dict[str, Emit]:
    """How the rows of each dash table become events; rows without the key
    column are dropped."""
    emits: dict[str, Emit] = {}

    def _table(kind: str, key: Column, message: Column, event_type: str, data_type: str, desc: str, part: str,
               raw: bool = True, times: list | None = None, **attrs) -> None:
        emits[kind] = Emit(
            where=key != "", event_type=event_type, data_type=data_type, message=message,
            times=times or [(collected(), desc)], source=_source(part),
            attrs=attrs | ({"raw": _raw()} if raw else {}),
        )

    user = _pick("User ID", "Account ID")
    _table(
        "accounts", user, F.concat(say("ESXi account: {u}", u=user), opt(" ({Description})")),
        "account_created", "esxi:user:account", "Account Created/Modified", "esxcli system account",
        username=user, description="Description",
    )
    _table(
        "permissions", rec("Principal"), say("Permission: {Principal} -> {Role}"),
        "account_permission", "esxi:user:permission", "Collection Time (Permission Configured)",
        "esxcli system permission", raw=False,
        principal="Principal", role="Role", is_group="Is Group", propagate="Propagate",
    )
    _table(
        "firewall_rulesets", rec("Name"), say("Firewall ruleset: {Name} [Enabled={Enabled}]"),
        "firewall_rule", "esxi:firewall:ruleset", "Collection Time (Firewall Rule)", "firewall ruleset",
        setting=F.lit("ruleset"), ruleset_name="Name", enabled="Enabled",
    )
    name = _pick("Ruleset", "Name")
    _table(
        "firewall_rules", name,
        say("Firewall rule: {n} {Direction} {Protocol} {Port Type}/{Port}-{End Port}", n=name),
        "firewall_rule", "esxi:firewall:rule", "Collection Time (Firewall Rule)", "firewall rule",
        setting=F.lit("rule"), ruleset_name=name, direction="Direction", protocol="Protocol",
        port_type="Port Type", port_begin="Port", port_end="End Port",
    )
    _table(
        "filesystems", rec("Mount Point"), say("Datastore: {Volume Name} ({Type}) at {Mount Point}"),
        "datastore", "esxi:storage:filesystem", "Collection Time (Datastore Mounted)", "storage filesystem", raw=False,
        volume_name="Volume Name", mount_point="Mount Point", fs_type="Type", uuid="UUID", size="Size", free="Free",
    )
    installed = F.when(rec("Install Date") != "", event_time(F.concat(rec("Install Date"), F.lit("T00:00:00"))))
    _table(
        "packages", rec("Name"), say("VIB: {Name} v{Version} [{Vendor}, {Acceptance Level}]"),
        "installed_program", "esxi:vib:installed", "", "software vib list", raw=False,
        times=[
            (installed, "Program Install Date"),
            (F.when(rec("Install Date") == "", collected()), "Collection Time (Program Installed)"),
        ],
        program_name="Name", version="Version", vendor="Vendor", acceptance_level="Acceptance Level",
        install_date="Install Date", source=F.lit("esxcli vib"),
    )
    device = _pick("Device", "Device Display Name")
    _table(
        "multipath_devices", device,
        say("Multipath Device: {d} [{Path Selection Policy}, {Storage Array Type}]", d=device),
        "esxi_multipath", "esxi:storage:multipath", "Collection Time (Multipath Device)", "Multipathing",
        device=device, path_policy="Path Selection Policy", storage_array_type="Storage Array Type",
    )
    _table(
        "multipath_paths", rec("Runtime Name"), say("Multipath Path: {Runtime Name} -> {Device} [{State}]"),
        "esxi_multipath_path", "esxi:storage:multipath_path", "Collection Time (Multipath Path)", "Multipathing",
        runtime_name="Runtime Name", device="Device", state="State", adapter="Adapter",
    )
    _table(
        "fc_adapters", rec("Adapter"), say("FC Adapter: {Adapter} WWPN={Port Name}"),
        "esxi_scsi", "esxi:storage:scsi_adapter", "Collection Time (SCSI FC Adapter)", "SCSI",
        adapter="Adapter", wwnn="Node Name", wwpn="Port Name",
    )
    _table(
        "iscsi_adapters", rec("Adapter"), say("iSCSI Adapter: {Adapter} ({Name})"),
        "esxi_iscsi", "esxi:storage:iscsi_adapter", "Collection Time (SCSI iSCSI Adapter)", "SCSI",
        adapter="Adapter", name="Name", driver="Driver",
    )
    domain = _pick("Domain", "Name")
    _table(
        "security_policies", domain,
        say("Security Policy: {d} [Enforcement={Enforcement Level}, Enabled={Enabled}]", d=domain),
        "esxi_secpolicy", "esxi:security:policy", "Collection Time (Security Policy)", "SecurityPolicy",
        domain=domain, enforcement_level="Enforcement Level", enabled="Enabled",
    )
    nic = _pick("Name", "Interface")
    ip4, mask = _pick("IPv4 Address", "Address"), _pick("IPv4 Netmask", "Netmask")
    _table(
        "nics", nic, say("VMkernel NIC: {n} {a}/{m} [{Address Type}]", n=nic, a=ip4, m=mask),
        "esxi_vmknic", "esxi:network:vmknic", "Collection Time (VMkernel NIC)", "VmkNic",
        interface=nic, ipv4_address=ip4, netmask=mask, gateway="IPv4 Gateway", address_type="Address Type",
    )
    ip6 = _pick("IPv6 Address", "Address")
    _table(
        "nics_v6", nic, say("VMkernel NIC (IPv6): {n} {a}/{Prefix Length}", n=nic, a=ip6),
        "esxi_vmknic", "esxi:network:vmknic_ipv6", "Collection Time (VMkernel NIC IPv6)", "VmkNic",
        interface=nic, ipv6_address=ip6, prefix_length="Prefix Length", address_type="Type",
    )
    _table(
        "port_groups", rec("Name"), say("Portgroup: {Name} on {Virtual Switch} (VLAN {VLAN ID})"),
        "esxi_portgroup", "esxi:network:portgroup", "Collection Time (vSwitch Portgroup)", "VmkNic",
        name="Name", virtual_switch="Virtual Switch", vlan_id="VLAN ID",
    )
    _table(
        "wbem_config", F.concat(rec("Enabled"), rec("Port"), rec("Loglevel")),
        say("WBEM Config: Enabled={Enabled} Port={Port} Loglevel={Loglevel}"),
        "esxi_wbem", "esxi:system:wbem_config", "Collection Time (WBEM Configuration)", "WBEM",
        enabled="Enabled", port="Port", loglevel="Loglevel",
    )
    _table(
        "wbem_providers", rec("Name"), say("WBEM Provider: {Name} [{Status}]"),
        "esxi_wbem_provider", "esxi:system:wbem_provider", "Collection Time (WBEM Provider)", "WBEM",
        provider_name="Name", status="Status",
    )
    cpu = _pick("CPU", "Id")
    _table(
        "cpus", cpu, say("CPU: {c} - {Brand} (Family {Family}, Model {Model})", c=cpu),
        "esxi_cpu", "esxi:hardware:cpu", "Collection Time (CPU Info)", "Hardware",
        cpu_id=cpu, family="Family", model="Model", brand="Brand",
    )
    _table(
        "pci_devices", rec("Address"), say("PCI: {Address} - {Vendor Name} {Device Name} ({Device Class Name})"),
        "esxi_pci", "esxi:hardware:pci", "Collection Time (PCI Device)", "Hardware",
        address="Address", vendor_name="Vendor Name", device_name="Device Name", class_name="Device Class Name",
    )

    return emits


def _table_builder(kind: str):
    def rows(df: DataFrame) -> DataFrame:
        return build(df, _table_emits()[kind])

    return rows


for _kind in TABLE_KINDS:
    builder(f"esxi.{_kind}")(_table_builder(_kind))


@builder("esxi.logons")
def logons(df: DataFrame) -> DataFrame:
    """Login lists without a usable date: reported at collection time."""
    text = F.trim("line")
    df = df.where((text != "") & ~text.startswith("wtmp")).withColumn("_parts", whitespace_fields())
    df = df.where(F.size("_parts") >= 3).withColumn("rec", F.create_map(
        F.lit("user"), F.get("_parts", F.lit(0)), F.lit("tty"), F.get("_parts", F.lit(1)), F.lit("from"), F.get("_parts", F.lit(2)),
    ))
    return build(df, Emit(
        event_type="logon_success", data_type="esxi:auth:wtmp",
        message=say("Logon: user={user} tty={tty} from={from}"),
        times=[(collected(), "Logon Recorded")], source=_source(F.col("source")),
        attrs={
            "username": "user", "terminal": "tty", "source_ip": "from", "raw_line": F.col("line"),
            "source": F.col("source"),
        },
    ))


@builder("esxi.ssh_keys")
def ssh_keys(df: DataFrame) -> DataFrame:
    spec = ssh_specs("esxi", _source("SSH"), with_user=False)["keys"]
    spec.attrs = spec.attrs | {"artifact_path": F.concat(F.lit("ssh/"), F.col("rel"))}
    return build(key_lines(df), spec)


@builder("esxi.ssh_config")
def ssh_config(df: DataFrame) -> DataFrame:
    spec = ssh_specs("esxi", _source("SSH"), with_user=False)["config"]
    spec.attrs = spec.attrs | {"artifact_path": F.concat(F.lit("ssh/"), F.col("rel"))}
    keys = F.lower(base_name(F.col("rel"))).isin("authorized_keys", "authorized_keys2")
    return build(df.where(~keys), spec)


@builder("esxi.persistence")
def persistence(df: DataFrame) -> DataFrame:
    rel = F.col("rel")
    origin = F.concat(F.lit("/"), rel)
    kind = (
        F.when(rel.contains("init.d"), F.lit("init_script"))
        .when(rel.endswith("rc.local") | rel.endswith("local.sh"), F.lit("rc_local"))
        .when(rel.contains("cron"), F.lit("cron"))
        .otherwise(F.lit("persistence"))
    )
    return build(df, Emit(
        fan_out=True,
        event_type="startup_item", data_type="esxi:persistence:file",
        message=F.concat(F.lit("Persistence ("), kind, F.lit("): "), origin),
        times=two_times("File Modified", "Collection Time (Persistence Configured)"), source=_source("Persistence"),
        attrs={
            "config_type": F.lit("Persistence"), "description": base_name(origin), "location": origin,
            "category": kind, "file_size": F.col("size"), "artifact_path": F.concat(F.lit("persistence/"), rel),
        },
    ))


# Configuration keys kept of a VM file.
VM_KEYS = {
    "displayName": "display_name", "guestOS": "guest_os", "uuid.bios": "uuid_bios", "vc.uuid": "vc_uuid",
    "annotation": "annotation", "ethernet0.address": "mac_address", "memSize": "mem_size", "numvcpus": "num_vcpus",
}
VM_EXTENSIONS = [".vmx", ".vmsd", ".nvram", ".log"]


@builder("esxi.vm_files")
def vm_files(df: DataFrame) -> DataFrame:
    """VM files (`rel`, `size`, `mtime`, `text` of configurations or NULL)."""
    rel = F.col("rel")
    ext = F.lower(F.regexp_extract(rel, r"(\.[^./]*)$", 1))
    log = ext == ".log"

    def setting(key: str) -> Column:
        quoted = key.replace(".", r"\.")
        raw = F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), rf'(?m)^[ \t]*{quoted}[ \t]*=[ \t]*(.*)$', 1)
        return F.when(ext == ".vmx", F.trim(F.regexp_replace(F.trim(raw), '^"+|"+$', "")))

    name = setting("displayName")
    df = df.withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    return build(df.where(ext.isin(VM_EXTENSIONS)), Emit(
        event_type=F.when(log, F.lit("vm_log")).otherwise(F.lit("vm_inventory")), data_type="esxi:vm:file",
        message=F.when(name != "", F.concat(F.lit("VM config: "), name)).otherwise(F.concat(F.lit("VM file: "), rel)),
        times=[(F.col("mtime"), F.when(log, F.lit("VM Log Captured")).otherwise(F.lit("VM Config Captured")))],
        source=_source("VM files"),
        attrs={
            "file_path": rel, "file_name": base_name(rel), "file_size": F.col("size"), "file_ext": ext,
            "artifact_path": F.concat(F.lit("vms/"), rel),
        } | {a: setting(k) for k, a in VM_KEYS.items()},
    ))


@builder("esxi.environment")
def environment(df: DataFrame) -> DataFrame:
    line = F.trim("line")
    name, value = F.substring_index(line, "=", 1), F.regexp_replace(line, "^[^=]*=", "")
    return build(df.where(line.contains("=") & (name != "")), Emit(
        event_type="esxi_environment", data_type="esxi:system:environment",
        message=F.concat(F.lit("Environment: "), name, F.lit(" = "), ellipsis(value, 100)), whole=value,
        times=[(collected(), "Collection Time (Environment Variable)")], source=_source("Environment"),
        attrs={"variable_name": name, "variable_value": value},
    ))
