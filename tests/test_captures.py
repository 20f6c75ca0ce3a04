"""A folder of captures of four platforms becomes events, every file set scanned once."""

import json

import pytest

from siftline.sources import captures
from siftline.sources.captures import capture_events, capture_frames

FILES = {
    "lin/manifest.json": {"platform": "Linux", "hostname": "box", "collection_timestamp": "2024-02-01T00:00:00Z"},
    "lin/live/processes.json": [{"pid": "1", "name": "init", "exe": "/sbin/init", "cmdline": "/sbin/init splash"}],
    "lin/live/packages.json": {"managers": [{"manager": "snap", "raw": "Name Version\ncore 16 1 x y\n"}]},
    "lin/live/docker_info.json": {"ServerVersion": "24"},
    "lin/live/docker_images.json": '{"ID":"i1","Repository":"nginx","Tag":"1"}\n{"ID":"i2","Repository":"redis","Tag":"2"}\n',
    "lin/live/network_netstat_an.txt": "tcp 0 0 10.0.0.1:22 10.0.0.2:5000 ESTABLISHED\n",
    "lin/live/firewall_iptables-save.txt": "*filter\n-A INPUT -j DROP\nCOMMIT\n",
    "lin/live/ulimit.txt": "core 0\nnofile 1024\n",
    "lin/live/journal_sshd.jsonl": '{"MESSAGE":"Accepted password for bob from 1.2.3.4 port 5 ssh2","__REALTIME_TIMESTAMP":"1704067200000000"}\nnot json\n',
    "lin/artifacts/users/etc/passwd": "root:x:0:0:root:/root:/bin/sh\n",
    "lin/artifacts/cron/crontab": "# c\n1 2 * * * root /bin/x\n",
    "lin/artifacts/ssh/users/bob/authorized_keys": "ssh-rsa AAAA bob@x\n",
    "lin/artifacts/shell_history/bob/bash_history": "ls -la\nid\n",
    "lin/artifacts/systemd/system/a.service": "[Unit]\n",
    "mac/manifest.json": {"platform": "macos", "hostname": "apple", "collection_timestamp": "2024-02-01T00:00:00Z"},
    "mac/live/processes.json": {"ps_auxwwe": "USER PID %CPU %MEM VSZ RSS TT STAT STARTED TIME COMMAND\nroot 7 0.0 0.1 1 2 ?? Ss 1Jan24 0:01 /sbin/launchd x\n"},
    "mac/live/firewall.json": {"alf_global": "Firewall is enabled."},
    "mac/live/users.json": {"dscacheutil_users": "name: bob\nuid: 501\n\nname: daemon\nuid: 1\n"},
    "mac/live/launchctl_list.txt": "PID\tStatus\tLabel\n-\t0\tcom.x.y\n",
    "esx/manifest.json": {"platform": "esxi", "hostname": "esx", "collection_timestamp": "2024-02-01T00:00:00Z"},
    "esx/live/software_vib_list.txt": "Name  Version  Vendor\n----  -------  ------\nvib1  1.0      acme\n",
    "esx/live/uptime.txt": "up 3 days\n", "esx/live/lockdown.txt": "disabled\n",
    "esx/live/process_list.txt": "vmx\n   Name: vmx\n   World ID: 5\n   Type: User\n\nsh\n   Name: sh\n   World ID: 6\n",
    "win/manifest.json": {"platform": "", "hostname": "pc", "collection_timestamp": "2024-02-01T00:00:00Z"},
    "win/live/dns_cache.json": [{"name": "a.test", "data": "1.1.1.1"}, {"name": "b.test"}],
    "win/live/processes.json": [{"pid": "9", "name": "cmd.exe"}],
    "win/sections/s.jsonl": '{"triggeredTask":{"name":"T","lastRunTime":"1704067200000"}}\n{"osConfigSetting":{"setting":"a","value":"b"}}\n{"other":{}}\n',
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("captures")
    for name, body in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body if isinstance(body, str) else json.dumps(body))
    return str(top)


def test_captures_become_events(spark, root):
    rows = capture_events(spark, root, "hq").collect()
    of = {}
    for r in rows:
        assert r["site_id"] == "hq" and r["datetime"] is not None
        of.setdefault(r["upload_id"], {}).setdefault(r["event_type"], set()).add(r["message"])
    assert {r["host_name"] for r in rows} == {"box", "apple", "esx", "pc"}
    lin, mac, esx, win = (of[c] for c in ("lin", "mac", "esx", "win"))
    assert {"Running: init (PID:1) /sbin/init splash"} == lin["running_process"]
    assert lin["shell_command"] == {"Shell command: ls -la (User: bob)", "Shell command: id (User: bob)"}
    assert any("core" in m for m in lin["installed_program"]) and any("bob" in m for m in lin["logon_success"])
    assert {"iptables rule: -A INPUT -j DROP"} <= lin["firewall_rule"] and any(m.startswith("Resource limits (ulimit): core 0; nofile") for m in lin["os_config"])
    assert any("Cron entry: 1 2 * * * root /bin/x" == m for m in lin["scheduled_task"]) and any("root" in m for m in lin["account_created"])
    assert sum("nginx" in m or "redis" in m for s in lin.values() for m in s) == 2 and "Systemd service: a" in lin["startup_item"]
    assert mac["running_process"] == {"Running: launchd (PID:7) /sbin/launchd x"}
    assert mac["account_created"] == {"User account: bob", "User account: daemon [system]"}
    assert "Application Firewall: Firewall is enabled." in mac["os_config"] and any("com.x.y" in m for s in mac.values() for m in s)
    assert any("vib1" in m for s in esx.values() for m in s)
    assert {"System: Uptime = up 3 days", "System: Lockdown Mode = disabled", "Security: Lockdown = disabled"} <= esx["os_config"]
    assert {m.split(" [")[0] for m in esx["running_process"]} == {"Running: vmx (World:5)", "Running: sh (World:6)"}
    assert win["dns_cache_entry"] == {"DNS Cache: a.test -> 1.1.1.1", "DNS Cache: b.test (no data cached)"} and "Running: cmd.exe (PID:9)" in win["running_process"]
    assert "OS Config: a = b" in win["os_config"]


def test_every_file_set_is_scanned_once(spark, root, monkeypatch):
    staged = []
    real = captures.Captures.staged
    monkeypatch.setattr(captures.Captures, "staged", lambda self, rows, name: staged.append((name, rows)) or real(self, rows, name))
    frames = capture_frames(spark, root)
    assert sorted(n for n, _ in staged) == ["capture-files", "capture-lines", "capture-records", "capture-sections"]
    for kind, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # Builders read their partition of a staged table, and no file of a capture.
        assert root not in plan and "FileScan text" not in plan, kind
        assert "PartitionFilters: [isnotnull(kind" in plan, kind


def test_no_captures(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "manifest.json").write_text(json.dumps({"platform": "linux"}))
    assert capture_frames(spark, str(tmp_path)) == {}
