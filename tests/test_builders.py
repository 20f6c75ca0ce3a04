"""Builders on hand-written records and texts; expected texts follow the
published behaviour of each parser."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import browsers, esxi, linux, macos, records as recs, registry, sections
from siftline.operators.build import BUILDERS, run_all
from siftline.operators.lines import dash_table
from tests.helpers import lines, messages, one, records


def build(spark, kind, *rows, **columns):
    return BUILDERS[kind](records(spark, list(rows), **columns))


def build_lines(spark, kind, text, **columns):
    return BUILDERS[kind](lines(spark, text, **columns))


def test_every_builder_emits_the_event_schema(spark):
    from siftline.schema import EVENT_COLUMNS

    needs = {"line": "x", "line_no": 1, "file": "f", "rel": "r", "size": 1, "manager": "m", "source": "last", "text": "t", "db_path": "d", "app": "a", "user": "u"}
    wide = records(spark, [{"a": "b"}]).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    for name, value in needs.items():
        wide = wide.withColumn(name, F.lit(value))
    for kind, fn in BUILDERS.items():
        assert fn(wide).columns == EVENT_COLUMNS, kind


def test_unknown_kind_is_refused(spark):
    with pytest.raises(KeyError):
        run_all({"nothing": records(spark, [{}])})


# -------------------------------------------------------------------- sections

def test_section_process_routes(spark):
    rows = [
        {"extractor": "LiveSnapshot", "name": "a", "pid": "1", "args": "x" * 120},
        {"sourceInfo": '{"extractor":"SystemAPI"}', "startTime": "1704067200000", "name": "b", "pid": "2", "args": "-v"},
        {"startTime": "1704067200000", "sourceInfo": '{"subType":"Prefetch"}', "userID": "bob"},
        {"name": "no time"},
    ]
    out = {r["event_type"]: r for r in sections.processes(records(spark, rows)).collect()}
    assert out["running_process"]["message"] == "Running: a (PID:1) " + "x" * 100 + "..."
    assert out["running_process"]["timestamp_desc"] == "Collection Time (Process Running)"
    assert out["session_logon"]["message"] == "Process running: b (PID: 2) -v"
    assert out["process_execution"]["message"] == "Program executed: unknown (User: bob)"
    assert out["process_execution"]["source_long"] == "CollectionTool - Prefetch"
    assert len(out) == 3


def test_section_connections(spark):
    rows = [
        {"extractor": "LiveSnapshot", "type": "listeningPort", "localIP": "0.0.0.0", "localPort": "22", "pid": "4"},
        {"extractor": "SystemAPI", "time": "1704067200000", "localIP": "a", "localPort": "1", "remoteIP": "b", "remotePort": "2", "connectionType": "TCP"},
        {"sourceInfo": '{"lastWriteTime":1704067200000}', "remoteHostName": "srv", "remoteShareName": "c$"},
    ]
    assert messages(sections.connections(records(spark, rows))) == [
        "Listening: TCP 0.0.0.0:22 (PID:4)", "Network connection: a:1 → b:2 (TCP)", "Network share mounted: \\\\srv\\c$",
    ]


def test_section_accounts_and_sessions(spark):
    row = one(build(spark, "section.userAccount", {
        "dateCreated": "0", "lastLoginDate": "2024-01-01T00:00:00Z", "userID": "bob", "userDomain": "D", "userSID": "S-1-5-21-1-500",
        "accountType": "local", "adminPriv": "true", "loginCount": "7",
    }))
    assert row["message"] == "User account: D\\bob (local) [ADMIN]" and row["attrs"]["account_rid"] == "500"
    row = one(build(spark, "section.logonSession", {"endTime": "1704067200000", "userID": "x", "sourceIP": "9.9.9.9", "loginType": "3", "loginStatus": "failure"}))
    assert (row["message"], row["timestamp_desc"]) == ("Logon session: x from 9.9.9.9 (Type: 3) [failure]", "Logon Session End")


def test_section_tasks_web_log(spark):
    row = one(build(spark, "section.triggeredTask", {
        "dateCreated": "1704067200000", "state": "ready", "userID": "SYSTEM",
        "actions": '[{"path":"a.exe","args":"-x"},{"path":""},{"path":"b.exe"}]',
    }))
    assert row["message"] == "Scheduled Task: Unknown Task [ready] (Run as: SYSTEM)" and row["attrs"]["actions"] == "a.exe -x; b.exe"
    web = [
        {"dateCreated": "1704067200000", "type": "DOWNLOAD", "url": "u", "title": "t"}, {"dateAccessed": "1704067200000", "url": "u", "userID": "b"},
    ]
    out = {r["event_type"]: (r["message"], r["timestamp_desc"]) for r in BUILDERS["section.webArtifact"](records(spark, web)).collect()}
    assert out == {"web_download": ("Download: t (u)", "Web Download Time"), "web_visit": ("Visited: u [b]", "Web Page Accessed")}
    row = one(build(spark, "section.logLine", {"time": "1704067200000", "logName": "L", "eventID": "5", "payload": '{"k":"v","n":1}'}))
    assert row["message"] == "Log: L Event 5" and row["attrs"]["k"] == "v" and row["attrs"]["event_id"] == "5" and row["attrs"]["n"] == "1"


def test_section_significance(spark):
    row = one(build(spark, "section.osConfigSetting", {"setting": "PATH", "value": "v" * 90, "analysisResults": '[{"significance":"LikelyNotable"}]'}))
    assert row["message"] == "OS Config: PATH = " + "v" * 80 + "..." and row["ct_significance"] == "LikelyNotable"
    row = one(build(spark, "section.configItem", {"sourceInfo": '{"lastWriteTime":1704067200000,"keyName":"K"}', "args": "-a"}))
    assert row["message"] == "Startup item configured: unknown (-a)" and row["attrs"]["registry_key"] == "K"
    row = one(build(spark, "section.logonData", {"sourceInfo": '{"lastWriteTime":1704067200000}', "remoteHostName": "h", "remoteUser": "u", "remoteDomain": "D"}))
    assert row["message"] == "RDP connection to h as D\\u"
    row = one(build(spark, "section.userAccessedData", {"maxLastAccessDate": "1704067200000", "path": "p"}))
    assert (row["message"], row["source_long"]) == ("File accessed: p", "CollectionTool - MRU")


def test_uncalled_shapes(spark):
    assert messages(build(spark, "amcache.entry", {"key_timestamp": "2024-01-01T00:00:00Z", "key_name": "k", "ProductName": "P"})) == ["Amcache: k (P)"]
    assert messages(build(spark, "amcache.program", {"install_date_iso": "2024-01-01T00:00:00Z", "Name": "N", "Version": "1", "Publisher": "P"})) == ["Installed Program: N v1 by P"]
    assert messages(build(spark, "registry.task_cache", {"last_written_time": "2024-01-01T00:00:00Z", "task_identifier": "{1}"})) == ["Scheduled Task: {1}"]
    assert messages(build(spark, "usage_record.application", {"timestamp": "2024-01-01T00:00:00Z", "application": "\\d\\a.exe", "foreground_cycle_time": "900000000"})) == ["SRUM: a.exe (CPU: 1.5m)"]
    assert messages(build(spark, "usage_record.connectivity", {"timestamp": "2024-01-01T00:00:00Z", "connected_time": "30"})) == ["SRUM Network: Unknown via Unknown (30s connected)"]
    assert messages(build(spark, "usage_record.bytes", {"timestamp": "2024-01-01T00:00:00Z", "bytes_sent": "2048"}, {"timestamp": "2024-01-01T00:00:00Z"})) == ["SRUM Data: Unknown - In:0B Out:2.0KB"]
    assert messages(build(spark, "access_log.client", {"timestamp": "2024-01-01T00:00:00Z", "total_accesses": "3"})) == ["UAL: Anonymous from Unknown -> Unknown Service (3 total accesses)"]
    assert messages(build(spark, "access_log.dns", {"timestamp": "2024-01-01T00:00:00Z", "hostname": "h"})) == ["DNS Query: Unknown -> h"]
    assert messages(build(spark, "activity.record", {"timestamp": "2024-01-01T00:00:00Z", "activity_type": "5", "tag": "t"})) == ["Timeline: Type-5 - Unknown (t)"]
    assert messages(build(spark, "activity.engaged", {"timestamp": "2024-01-01T00:00:00Z", "application": "a", "duration_seconds": "7200"})) == ["User Engaged: a (2.0h)"]


# ------------------------------------------------------------------------ live

def test_live_processes(spark):
    modules = "[" + ",".join('"m"' for _ in range(51)) + "]"
    rows = [{"pid": "1", "user": "D\\bob", "modules": '["a","b"]', "start_time": "2024-01-01T00:00:00Z"}, {"pid": "2", "name": "n", "modules": modules}]
    out = {r["attrs"]["pid"]: r for r in BUILDERS["live.processes"](records(spark, rows)).collect()}
    assert out["1"]["message"] == "Running: unknown (PID:1)" and out["1"]["attrs"]["user_domain"] == "D" and out["1"]["attrs"]["loaded_modules"] == "a; b"
    assert out["2"]["attrs"]["loaded_modules"] == "51 modules loaded" and "Collection Time" in out["2"]["timestamp_desc"]


def test_live_small_kinds(spark):
    assert messages(build(spark, "live.arp_cache", {"ip_address": "1", "mac_address": "m"}, {"mac_address": "x"})) == ["ARP Cache: 1 -> m"]
    assert messages(build(spark, "live.routing_table", {"destination": "d", "gateway": "0.0.0.0"}, {"destination": "e", "gateway": "g"})) == ["Route: d (direct)", "Route: e via g"]
    assert messages(build(spark, "live.logon_sessions", {"username": "u", "domain": "D", "logon_type": "2"})) == ["Logon session: D\\u (Type: 2)"]
    assert messages(build(spark, "live.services", {"name": "s", "display_name": "S", "status": "Running"}, {"name": "t", "display_name": "t", "status": "Off"})) == ["Service: s (S) [Running]", "Service: t [Off]"]
    assert messages(build(spark, "live.startup_items", {"name": "n", "command": "c" * 81})) == ["Startup item: n (" + "c" * 80 + "...)"]
    assert messages(build(spark, "live.devices", {"name": "d", "manufacturer": "m", "serial_number": "1"})) == ["Device: d (m) [S/N: 1]"]
    assert messages(build(spark, "live.user_accessed_data", {"type": "Recent", "path": "p", "user": "u"})) == ["Recent: p (User: u)"]
    assert messages(build(spark, "live.os_config", {"name": "n", "value": "v"})) == ["OS Config: n = v"]
    row = one(build(spark, "live.user_accounts", {"username": "u", "is_disabled": "true", "groups": '["administrators"]'}))
    assert row["message"] == "User account: u [DISABLED] [ADMIN]" and row["attrs"]["account_status"] == "disabled"


# ----------------------------------------------------------------------- Linux

def test_linux_sockets(spark):
    text = (
        "Netid State Recv-Q Send-Q Local Address:Port Peer Address:Port Process\n"
        'tcp LISTEN 0 128 0.0.0.0:22 0.0.0.0:* users:(("sshd",pid=12,fd=3))\n'
        "udp UNCONN 0 0 [::1]:53 *:*\ntcp ESTAB 0 0 1.1.1.1:22 2.2.2.2:99\nshort line"
    )
    assert messages(build_lines(spark, "linux.sockets", text)) == [
        "Connected: 1.1.1.1:22 -> 2.2.2.2:99 [ESTAB]", "Listening: tcp 0.0.0.0:22 (sshd PID:12)", "UDP Socket: ::1:53 [UNCONN]",
    ]
    net = "Active\nProto R S Local Foreign State\ntcp 0 0 1.1.1.1:22 0.0.0.0:* LISTEN\nudp 0 0 0.0.0.0:68 0.0.0.0:*"
    assert messages(build_lines(spark, "linux.netstat", net)) == ["Listening: tcp 1.1.1.1:22", "UDP Listener: 0.0.0.0:68"]
    both = linux.sockets_or_netstat(lines(spark, text), lines(spark, net))
    assert both.count() == 3
    only = linux.sockets_or_netstat(lines(spark, "x"), lines(spark, net))
    assert only.count() == 2


def test_linux_accounts_and_logons(spark):
    text = "root:x:0:0:root:/root:/bin/sh\n# c\nbob:x:1000:1000::/home/bob:/bin/bash\nbad:line"
    assert messages(build_lines(spark, "linux.passwd", text)) == ["User account: bob", "User account: root (root) [system]"]
    text = "bob pts/0 9.9.9.9 Thu Apr 20 18:00:01 2023 - Thu Apr 20 19:00:00 2023\nwtmp begins x\nx y z a b c d e"
    out = BUILDERS["linux.logons"](lines(spark, text, source="lastb")).collect()
    assert {(str(r["datetime"]), r["event_type"]) for r in out} == {("2023-04-20 18:00:01", "logon_failed"), ("2024-02-01 00:00:00", "logon_failed")}


def test_linux_text_tables(spark):
    assert messages(build_lines(spark, "linux.fstab", "/dev/sda1 / ext4 rw 0 1\n# x\nshort")) == ["Mount: /dev/sda1 -> / (ext4)"]
    assert messages(build_lines(spark, "linux.exports", "/srv *(ro)\n")) == ["NFS export: /srv *(ro)"]
    assert messages(build_lines(spark, "linux.modules", "Module Size Used by\nxfs 100 1 a,b\nbare 5")) == ["Kernel module: bare (5 bytes)", "Kernel module: xfs (100 bytes) used by: a,b"]
    listing = "-rwsr-xr-x 1 root wheel 100 Jan 1 2024 /bin/su\n/bin/odd"
    assert messages(build_lines(spark, "linux.suid", listing)) == ["SUID binary: /bin/odd", "SUID binary: /bin/su (owner=root, perms=-rwsr-xr-x)"]
    assert messages(build_lines(spark, "linux.sgid", listing))[1] == "SGID binary: /bin/su (group=wheel, perms=-rwsr-xr-x)"
    shm = "------ Shared Memory Segments ------\nkey shmid owner perms bytes nattch\n0x0 5 root 600 1024 2"
    assert messages(build_lines(spark, "linux.shared_memory", shm)) == ["Shared memory: 5 (owner=root, 1024 bytes, 2 attached)"]
    assert messages(build_lines(spark, "linux.environment", "A_TOKEN=x\nB=1=2\nnone")) == ["Environment: A_TOKEN=[REDACTED]", "Environment: B=1=2"]
    cron = "# c\nSHELL=/bin/sh\n* * * * * root run"
    assert messages(build_lines(spark, "linux.cron_lines", cron, file="crontab")) == ["Cron entry: * * * * * root run"]
    assert messages(build_lines(spark, "linux.cron_files", "x", file="cron.d/a")) == ["Crontab modified: /etc/cron.d/a"]
    keys = "ssh-rsa AAA bob at home\n# c\nshort"
    assert messages(build_lines(spark, "linux.ssh_keys", keys, file="users/bob/authorized_keys")) == ["SSH authorized_key: ssh-rsa bob at home (user: bob)"]
    assert messages(build_lines(spark, "linux.ssh_hosts", "h ssh-rsa AAA", file="known_hosts")) == ["SSH known_host: h (ssh-rsa)"]
    assert messages(build_lines(spark, "linux.ssh_config", "x", file="etc/SSHD_CONFIG")) == ["SSH config file: sshd_config"]


def test_linux_texts(spark):
    assert messages(build(spark, "linux.firewall", {"label": "iptables", "text": "*filter\n-A INPUT -j DROP"}, {"label": "ufw", "text": " "})) == [
        "iptables rule: -A INPUT -j DROP", "iptables ruleset captured (24 bytes): *filter",
    ]
    assert messages(build(spark, "linux.system_info", {"hostname": "h\nx", "uptime": " "})) == ["System: Hostname = h"]
    assert messages(build(spark, "linux.status_texts", {"kind": "selinux", "text": "a\nb"}, {"kind": "ulimit", "text": "c"})) == ["Resource limits (ulimit): c", "SELinux: a; b"]
    assert messages(build(spark, "linux.docker_images", {"ID": "0123456789abcdef", "Repository": "r", "Tag": "<none>", "Size": "5MB"})) == ["Docker image: r (0123456789ab) - 5MB"]
    assert messages(build(spark, "linux.docker_networks", {"ID": "n1", "Name": "br", "Driver": "b"})) == ["Docker network: br (n1) driver=b"]
    assert messages(build(spark, "linux.docker_volumes", {"Name": "v", "Driver": "local"})) == ["Docker volume: v driver=local"]
    assert messages(build(spark, "linux.processes", {"pid": "1", "exe": "/bin/sh", "cmdline": "sh -c"}, {"name": "x"})) == ["Running: sh (PID:1) sh -c"]
    unit = BUILDERS["linux.units"](lines(spark, "x", file="system/a.service")).collect()
    assert {(r["message"], r["timestamp_desc"]) for r in unit} == {
        ("Systemd service: a", "Unit File Modified"), ("Systemd service: a", "Collection Time (Service Configuration)"),
    }


def test_shell_history_forms(spark):
    text = "ls\n: 1700000000:0;echo a;b\n: x\n"
    out = {r["attrs"]["command"]: str(r["datetime"]) for r in BUILDERS["linux.shell_history"](lines(spark, text, file="bob/.zsh_history")).collect()}
    assert out == {"ls": "2024-01-15 10:00:00", "echo a;b": "2023-11-14 22:13:20", ": x": "2024-01-15 10:00:00"}
    fish = "- cmd: one\n  when: 1700000000\n- cmd: two\n  paths:\n    - x"
    out = {r["attrs"]["command"]: str(r["datetime"]) for r in BUILDERS["linux.shell_history"](lines(spark, fish, file="bob/fish_history")).collect()}
    assert out == {"one": "2023-11-14 22:13:20", "two": "2024-01-15 10:00:00"}


# ----------------------------------------------------------------------- macOS

def test_macos_texts(spark):
    ps = "USER PID x\nroot 1 0.0 0.1 1 2 ?? Ss 1Jan 0:01 /sbin/launchd -x\nbob 0 0 0 0 0 0 0 0 0 z"
    assert messages(build_lines(spark, "macos.processes", ps)) == ["Running: launchd (PID:1) /sbin/launchd -x"]
    net = "Proto\ntcp4 0 0 10.0.0.5.443 1.2.3.4.99 ESTABLISHED\ntcp46 0 0 *.443 *.* LISTEN\nudp4 0 0 10.0.0.5.53 *.*"
    assert messages(build_lines(spark, "macos.netstat", net)) == [
        "Connected: 10.0.0.5:443 -> 1.2.3.4:99 [ESTABLISHED]", "Listening: tcp46 :443 [LISTEN]", "UDP Listener: 10.0.0.5:53",
    ]
    lsof = "COMMAND\nsshd 12 root 3u IPv4 0x1 0t0 TCP 10.0.0.5:22->10.0.0.6:51 (ESTABLISHED)\nmdns 2 _m 7u IPv4 0x2 0t0 UDP *:5353"
    assert messages(build_lines(spark, "macos.open_sockets", lsof)) == [
        "Connected: 10.0.0.5:22 -> 10.0.0.6:51 (sshd PID:12 root)", "UDP Listener: *:5353 (mdns PID:2 _m)",
    ]
    alf = "Total number of apps = 1\n1 : /A.app\n   (Allow incoming connections)\nnoise"
    assert messages(build_lines(spark, "macos.firewall_apps", alf)) == ["Firewall rule: /A.app -- Allow incoming connections"]
    jobs = "PID\tStatus\tLabel\n-\t0\ta\n12\t0\tb\n-\t78\tc"
    assert messages(build_lines(spark, "macos.launchd_services", jobs)) == ["launchd: a [loaded]", "launchd: b [running]", "launchd: c [exited(78)]"]
    users = "name: root\nuid: 0\ngecos: Admin\n\nname: bob\nuid: 501\n\nuid: 9"
    assert messages(build_lines(spark, "macos.users", users)) == ["User account: bob", "User account: root (Admin) [system]"]
    history = "Installations:\n\n    macOS 15:\n\n      Version: 15\n      Source: Apple\n      Install Date: 5/8/25, 4:14 PM\n\n    Tool:\n      Version: 2"
    out = {r["message"]: str(r["datetime"]) for r in BUILDERS["macos.install_history"](lines(spark, history)).collect()}
    assert out == {"Installed Program: macOS 15 v15 (Apple)": "2025-05-08 16:14:00", "Installed Program: Tool v2": "2024-02-01 00:00:00"}
    btm = " #1:\n  Name: (null)\n  Identifier: id1\n  Type: agent\n #2:\n  Name: N\n  Disposition: [enabled]"
    assert messages(build_lines(spark, "macos.background_items", btm)) == ["BTM persistence: N [[enabled]]", "BTM persistence: id1 (agent)"]


def test_macos_files_and_bags(spark):
    plist = records(spark, [{"ProgramArguments": '["/x","-a"]', "StartInterval": "60"}]).withColumn("rel", F.lit("users/bob/LaunchAgents/a.plist")).withColumn(
        "size", F.lit(5)).withColumn("mtime", F.lit("2024-01-15").cast("timestamp"))
    out = macos.launch_plists(plist).collect()
    assert {r["timestamp_desc"] for r in out} == {"Plist Modified", "Collection Time (Persistence Configured)"}
    assert out[0]["message"] == "LaunchAgent/Daemon: a -> /x" and out[0]["attrs"]["trigger"] == "interval=60s"
    assert out[0]["attrs"]["plist_path"] == "/Users/bob/Library/LaunchAgents/a.plist"
    assert messages(build_lines(spark, "macos.app_bundles", "x", file="Applications/My App.app/Contents/Info.plist")) == ["Installed Application: My App"]
    assert messages(build_lines(spark, "macos.persistence", "x", file="users/bob/.zshrc"))[0] == "Persistence (shell_init): /Users/bob/.zshrc"
    assert messages(build_lines(spark, "macos.recent_items", "x", file="users/bob/r.sfl")) == ["Recent items file: r.sfl (user: bob)"]
    assert messages(build(spark, "macos.system_info", {"csrutil_status": "enabled"})) == ["System: SIP = enabled"]
    assert messages(build(spark, "macos.backups", {"status": "ok"})) == ["Time Machine status: ok"]
    assert messages(build(spark, "macos.firewall", {"key": "alf_global", "text": "on"}, {"key": "pfctl_info", "text": "abc"})) == ["Application Firewall: on", "pfctl pfctl_info captured (3 bytes)"]
    assert messages(build_lines(spark, "macos.receipts", "com.x\n\n")) == ["pkgutil package: com.x"]
    assert messages(build(spark, "macos.permissions", {"service": "kTCCServiceCamera", "client": "c", "auth_value": "2", "scope": "user", "user": "b"})) == ["TCC grant: c -> ServiceCamera = allowed (user b)"]
    row = one(build(spark, "macos.quarantine", {"LSQuarantineTimeStamp": "725760000", "LSQuarantineDataURLString": "u", "LSQuarantineAgentName": "Safari"}))
    assert (row["message"], str(row["datetime"])) == ("Download: u (via Safari)", "2024-01-01 00:00:00")


# ------------------------------------------------------------------------ ESXi

def test_esxi(spark):
    table = "Proto  Local Address   Foreign Address  State   World ID  World Name\n-----  --------------  ---------------  ------  --------  ----------\ntcp    10.0.0.1:443    0.0.0.0:0        LISTEN  77        hostd web\nudp    10.0.0.1:53     0.0.0.0:0                78\n"
    frame = dash_table(records(spark, [{}]).withColumn("text", F.lit(table)).drop("rec"))
    assert messages(BUILDERS["esxi.connections"](frame)) == ["Listening: tcp 10.0.0.1:443 (hostd web World:77)", "UDP Socket: 10.0.0.1:53"]
    vms = "Vmid Name File Guest OS Version\n1 My VM [ds1] My VM/My VM.vmx windows10_64Guest vmx-19 notes\nx y"
    power = spark.createDataFrame([("u1", "1", "Powered on")], "upload_id string, vm_id string, power_state string")
    row = one(esxi.vm_inventory(lines(spark, vms), power))
    assert row["message"] == "VM: My VM (Vmid:1) windows10_64Guest [Powered on]" and row["attrs"]["vmx_path"] == "[ds1] My VM/My VM.vmx"
    blocks = "hostd\n   Name: hostd\n   World ID: 5\n   Type: agent\n\nother\n   UID: 0"
    frame = esxi.key_value_blocks(records(spark, [{}]).withColumn("text", F.lit(blocks)).drop("rec"))
    assert messages(BUILDERS["esxi.processes"](frame)) == ["Running: hostd (World:5) [agent]"]
    frame = esxi.key_value_blocks(records(spark, [{}]).withColumn("text", F.lit("Enabled: true\nPort: 0\n")).drop("rec"))
    assert messages(BUILDERS["esxi.wbem_config"](frame)) == ["WBEM Config: Enabled=true Port=0 Loglevel="]
    assert messages(build(spark, "esxi.system_info", {"file": "uptime.txt", "text": "up\nx"}, {"file": "nope", "text": "x"})) == ["System: Uptime = up"]
    assert messages(build(spark, "esxi.security", {"file": "tpm.txt", "text": "none"})) == ["Security: TPM = none"]
    assert messages(build(spark, "esxi.accounts", {"User ID": "root", "Description": "Admin"})) == ["ESXi account: root (Admin)"]
    assert messages(build(spark, "esxi.nics", {"Interface": "vmk0", "Address": "1.1.1.1", "Netmask": "m", "Address Type": "DHCP"})) == ["VMkernel NIC: vmk0 1.1.1.1/m [DHCP]"]
    vmx = lines(spark, "x", file="a/My.vmx").withColumn("text", F.lit('guestOS = "w"\ndisplayName = "Prod"\nuuid.bios = "5"'))
    row = one(BUILDERS["esxi.vm_files"](vmx.withColumn("rec", F.expr("cast(map() as map<string,string>)"))))
    assert row["message"] == "VM config: Prod" and row["attrs"]["uuid_bios"] == "5"
    assert messages(build_lines(spark, "esxi.logons", "root pts/0 9.9.9.9 Thu\nwtmp x", source="last")) == ["Logon: user=root tty=pts/0 from=9.9.9.9"]
    assert messages(build_lines(spark, "esxi.persistence", "x", file="etc/init.d/a"))[0] == "Persistence (init_script): /etc/init.d/a"
    assert messages(build_lines(spark, "esxi.environment", "A=b=c\n=x")) == ["Environment: A = b=c"]


# -------------------------------------------------------------------- registry

def test_registry(spark):
    t = "2024-01-01T00:00:00Z"
    run = {"hive": "NTUSER.DAT", "key_path": r"software\Microsoft\Windows\CurrentVersion\Run", "key_time": t, "value_name": "App", "value_string": "a.exe"}
    assert messages(build(spark, "registry.run_keys", run, run | {"value_name": "(default)"})) == ["Startup item configured: App (a.exe)"]
    ticks = "00" * 60 + (133485408000000000).to_bytes(8, "little").hex()
    assist = {"hive": "h", "key_path": r"Software\Microsoft\Windows\CurrentVersion\Explorer\UserAssist\{G}\Count", "value_name": "Pzq.rkr", "value_hex": ticks}
    row = one(build(spark, "registry.user_values", assist))
    assert (row["message"], str(row["datetime"])) == ("Program executed (UserAssist): Cmd.exe", "2024-01-01 00:00:00")
    word = {"hive": "h", "key_path": r"Software\Microsoft\Windows\CurrentVersion\Explorer\WordWheelQuery", "key_time": t, "value_name": "0", "value_hex": "secret".encode("utf-16-le").hex() + "0000"}
    assert messages(build(spark, "registry.user_values", word)) == ["Search: secret"]
    mru = [{"hive": "h", "key_path": r"Software\Microsoft\Windows\CurrentVersion\Explorer\RunMRU", "key_time": t, "value_name": n, "value_string": v} for n, v in (("a", "cmd\\1"), ("b", "calc\\1"), ("MRUList", "ab"))]
    row = one(BUILDERS["registry.user_lists"](records(spark, mru)))
    assert row["message"] == "Run command executed: cmd" and row["attrs"]["commands"] == "cmd, calc"
    svc = [{"hive": "SYSTEM", "key_path": r"ControlSet001\Services\Svc", "key_time": t, "value_name": n, "value_string": v} for n, v in (("ImagePath", "x.sys"), ("Start", "2"))]
    row = one(BUILDERS["registry.services"](records(spark, svc)))
    assert row["message"] == "Service configured: Svc" and row["attrs"]["image_path"] == "x.sys"
    usb = {"hive": "SYSTEM", "key_path": r"ControlSet001\Enum\USBSTOR\Disk&Ven\123", "key_time": t}
    assert messages(build(spark, "registry.usb", usb)) == ["USB storage device: Disk&Ven (Serial: 123)"]
    bam = {"hive": "SYSTEM", "key_path": r"ControlSet001\Services\bam\State\UserSettings\S-1-5-21-1", "value_name": r"\Device\x\a.exe", "value_hex": (133485408000000000).to_bytes(8, "little").hex()}
    assert messages(build(spark, "registry.activity_moderator", bam, bam | {"value_name": "Version"})) == ["BAM execution: a.exe"]
    net = [{"hive": "S", "key_path": registry.NETWORK_PROFILES + r"\{1}", "key_time": t, "value_name": n, "value_string": v} for n, v in (("ProfileName", "Home"), ("Category", "1"))]
    assert messages(BUILDERS["registry.networks"](records(spark, net))) == ["Network profile: Home (Private)"]
    unin = [{"hive": "S", "key_path": registry.UNINSTALL + r"\{1}", "key_time": t, "value_name": "Publisher", "value_string": "P"}]
    assert messages(BUILDERS["registry.uninstall"](records(spark, unin))) == ["Software: {1} by P"]
    assert messages(build(spark, "registry.sam", {"hive": "SAM", "key_path": r"SAM\Domains\Account\Users\000001F4", "key_time": t})) == ["SAM User account (RID: 500)"]
    assert messages(build(spark, "registry.exclusions", {"hive": "S", "key_path": registry.EXCLUSIONS + r"\Paths", "key_time": t, "value_name": "C:\\x"})) == ["Defender exclusion (Paths): C:\\x"]
    assert messages(build(spark, "registry.shell_bags", {"hive": "U", "key_path": registry.SHELL_BAGS + r"\0\1", "key_time": t})) == ["Folder accessed (ShellBag): 1"]
    assert messages(build(spark, "registry.amcache", {"hive": "A", "key_path": registry.AMCACHE_FILES + r"\f1", "key_time": t, "value_name": "Name", "value_string": "n.exe"})) == ["Program evidence (Amcache): n.exe"]
    assert messages(build(spark, "registry.shim_cache", {"hive": "SYSTEM", "path": r"C:\a\b.exe", "modified": t})) == ["ShimCache: b.exe"]


# ------------------------------------------------------- browsers, small kinds

def test_browsers(spark):
    us = str(1704067200000000 + 11644473600000000)
    db = {"db_path": "/home/b/.config/google-chrome/History"}
    assert messages(build(spark, "linux.chromium_visits", {"visit_time": us, "url": "u", "title": "t"}, **db)) == ["Web visit: t (u)"]
    assert messages(build(spark, "linux.chromium_downloads", {"start_time": us, "target_path": "/d/f", "tab_url": "u"}, **db)) == ["Downloaded: f from u"]
    assert messages(build(spark, "linux.chromium_cookies", {"last_access_utc": us, "name": "n", "host_key": "h"}, **db)) == ["Cookie: n on h"]
    assert messages(build(spark, "linux.chromium_logins", {"date_last_used": us, "username_value": "u", "origin_url": "o"}, **db)) == ["Saved login: u @ o"]
    row = one(build(spark, "linux.firefox_places", {"last_visit_date": "1704067200000000", "url": "u"}, {"url": "never"}, **db))
    assert (row["message"], row["attrs"]["browser"]) == ("Web visit: u", "Firefox")
    assert messages(build(spark, "linux.firefox_cookies", {"lastAccessed": "1704067200000000", "name": "n", "host": "h"}, **db)) == ["Cookie: n on h"]
    row = one(build(spark, "macos.safari_visits", {"visit_time": "725760000", "url": "u", "title": "t"}))
    assert (row["message"], str(row["datetime"])) == ("t (u)", "2024-01-01 00:00:00")
    assert one(build(spark, "macos.chromium_downloads", {"browser": "edge", "start_time": us, "target_path": "p", "tab_url": "u"}))["data_type"] == "darwin:browser:edge:download"
    assert messages(build(spark, "macos.chromium_cookies", {"browser": "edge", "creation_utc": us, "name": "n", "host_key": "h"})) == ["Cookie n on h"]
    assert messages(build(spark, "macos.chromium_logins", {"browser": "edge", "date_created": us, "username_value": "u", "origin_url": "o"})) == ["Login saved: u @ o"]
    assert messages(build(spark, "macos.firefox_visits", {"visit_date": "1704067200000000", "url": "u"})) == ["u"]
    assert messages(build(spark, "macos.firefox_forms", {"lastUsed": "1704067200000000", "fieldname": "f", "value": "v"})) == ["Form value: f = v"]
    assert messages(build(spark, "macos.firefox_downloads", {"startTime": "1704067200000000", "source": "s", "target": "t"})) == ["Download: t <- s"]
    assert messages(build(spark, "macos.firefox_cookies", {"creationTime": "0", "name": "n", "host": "h"})) == ["Cookie n on h"]
    row = one(build(spark, "windows.chromium_urls", {"last_visit_time": us, "url": "u", "title": "t"}, {"last_visit_time": "0"}, db_path="Edge/bob_Default_History"))
    assert row["message"] == "Edge: t (u)" and row["attrs"]["user_id"] == "bob"
    assert messages(build(spark, "windows.firefox_visits", {"visit_date": "1704067200000000", "url": "u"}, db_path="x")) == ["Firefox: u"]


def test_newest_per_group_is_exact_under_skew(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise(F.lit("hot")).alias("g"), F.col("id").alias("v"))
    out = browsers.newest_per_group(df, ["g"], [F.col("v").desc()], 7, salts=4)
    got = {g: sorted(r["v"] for r in out.where(F.col("g") == g).collect()) for g in ("hot", "rare")}
    assert got["hot"] == sorted([i for i in range(3000) if i % 3][-7:]) and got["rare"] == sorted([i for i in range(3000) if i % 3 == 0][-7:])


def test_small_kinds(spark):
    size = {"path": "C:\\x", "file_size": "1536", "deletion_time": "133485408000000000"}
    assert messages(build(spark, "recycle_bin", size)) == ["Deleted: C:\\x (1.5 KB)"]
    lnk = {"file_name": "a.lnk", "local_base_path": "C:\\d\\t.doc", "creation_time": "2024-01-01T00:00:00Z", "access_time": "1969-01-01T00:00:00Z"}
    assert messages(build(spark, "shortcut", lnk)) == ["Shortcut target created: t.doc"]
    ps = BUILDERS["powershell_history"](lines(spark, "ls\n\niex (x)", file="Users/S-1-5-21-9/h.txt")).collect()
    assert {(r["message"], r["is_suspicious"], r["attrs"]["user_sid"]) for r in ps} == {("PS> ls", False, "S-1-5-21-9"), ("PS> iex (x)", True, "S-1-5-21-9")}
    hits = recs.occurrences(records(spark, [{"text": "ab" * 3 + "mshta" + "\u0001" + "mshta"}]), F.col("rec")["text"], ["mshta", "none"], width=3)
    assert [(r["pattern"], r["offset"], r["context"]) for r in hits.orderBy("offset").collect()] == [("mshta", 6, "babmsh"), ("mshta", 12, "ta.msh")]
    # Occurrences across blocks, at both ends, and of a pattern that ends inside another.
    text = "mshta" + "é" * 18 + "cmd.exemshta" + "x" * 7 + "certutil"
    found = recs.occurrences(records(spark, [{"text": text}]), F.col("rec")["text"], ["mshta", "cmd.exe", "certutil", "exem"], width=4, block=10)
    assert sorted((r["offset"], r["pattern"], r["context"]) for r in found.collect()) == [
        (0, "mshta", "msht"), (23, "cmd.exe", "....cmd."), (27, "exem", "cmd.exem"), (30, "mshta", ".exemsht"), (42, "certutil", "xxxxcert")]
    assert "rec" in found.columns and "_text" not in found.columns
    with pytest.raises(ValueError, match="overlap"):
        recs.occurrences(records(spark, [{"text": text}]), F.col("rec")["text"], ["abca"])
    rows = records(spark, [{"TimeStamp": "45292.0", "AppId": "5", "UserId": "6", "ConnectedTime": "9"}])
    ids = spark.createDataFrame([("u1", 6, "bob")], "upload_id string, id_index long, name string")
    assert messages(recs.usage_connectivity(recs.name_usage_ids(rows, ids, "Network"))) == ["Network connectivity: Network-5 (user: bob, connected: 9s)"]
    assert messages(recs.usage_application(recs.name_usage_ids(rows, ids))) == ["App usage: App-5 (user: bob, fg: 0, bg: 0)"]


# ---------------------------------------------------------- events told apart

def test_events_are_told_apart_by_their_whole_text(spark):
    from siftline.operators.build import emit

    long = "run " + "x" * 300
    df = lines(spark, "\n".join([long + " one", long + " two", long + " two"]), file="u/.bash_history")
    out = emit(BUILDERS["linux.shell_history"](df)).collect()
    assert sorted(r["attrs"]["command"][-3:] for r in out) == ["one", "two"] and len({r["message"] for r in out}) == 1
    hits = emit(BUILDERS["wmi_repository"](records(spark, [{"file": "f", "text": "mshta mshta mshta"}, {"file": "f", "text": "mshta"}]))).collect()
    assert sorted(int(r["attrs"]["offset"]) for r in hits) == [0, 6, 12] and all("text" not in r["attrs"] for r in hits)
    modules = '[' + ",".join(f'"m{i}"' for i in range(60)) + ']'
    process = BUILDERS["live.processes"](records(spark, [{"name": "a", "pid": "1", "modules": modules}])).collect()[0]["attrs"]
    assert process["loaded_modules"] == "60 modules loaded" and process["all_modules"].count(";") == 59
    deep = records(spark, [{"hive": "U", "key_path": registry.SHELL_BAGS + r"\0" * 14, "key_time": "2024-01-01T00:00:00Z"}])
    assert BUILDERS["registry.shell_bags"](deep).count() == 1


def test_first_of_equal_events_stays(spark):
    from siftline.operators.build import emit

    rows = [(s, m, {"k": str(s)}) for s in (5, 3, 9) for m in ("a", "b", None)]
    df = spark.createDataFrame(rows, "seq long, message string, attrs map<string,string>").withColumns({
        "upload_id": F.lit("u"), "datetime": F.lit("2024-01-01").cast("timestamp"), "timestamp_desc": F.lit(None).cast("string"), "event_type": F.lit("t")})
    assert {(r["message"], r["seq"], r["attrs"]["k"]) for r in emit(df.repartition(3)).collect()} == {("a", 3, "3"), ("b", 3, "3"), (None, 3, "3")}


def test_event_ids_tell_null_places_apart(spark):
    from siftline.sources.timeline import with_id

    df = spark.createDataFrame([("x", None, None), (None, "x", None), (None, None, "x"), ("x", None, None)], "timestamp_desc string, message string, content string")
    df = df.withColumns({"upload_id": F.lit("u"), "datetime": F.lit(0).cast("timestamp"), "event_type": F.lit("t")})
    ids = [r["id"] for r in with_id(df).collect()]
    assert ids[0] == ids[3] and len(set(ids)) == 3 and all(len(i) == 32 for i in ids)
