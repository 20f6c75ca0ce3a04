"""From a folder of captures to events: which file feeds which builder.

The folder holds one folder per capture with `manifest.json`, `live/`, `artifacts/` and
`sections/`. Every set of files is scanned once, whatever number of builders it feeds: a
row gets the kind of record it is by its file's place and the capture's platform, and is
staged in a table with one partition per kind, of which each builder reads its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.values import parse_map, parse_maps
from siftline.operators.build import BUILDERS, run_all
from siftline.operators.esxi import SECURITY_FILES, SYSTEM_FILES
from siftline.operators.lines import block_records, blocks
from siftline.session import shared_folder
from siftline.sources.records import LIVE_KINDS, SECTION_KINDS, read_manifests, with_captures
from siftline.sources.texts import dash_rows, read_lines, upload_of

LINUX, MACOS, ESXI, WINDOWS = "linux", "macos", "esxi", "windows"
KEYS = ["upload_id", "site_id", "host_name", "collection_ts", "seq"]

# ---------------------------------------------------------------- fixed values
#: Files of lines: platform, place below the capture, kind, mark (`source`).
LINES = [
    (LINUX, r"live/network_ss_-tunap\.txt", "linux.sockets", ""), (LINUX, r"live/network_netstat_an\.txt", "linux.netstat", ""),
    (LINUX, r"live/(?:logons_last_-Fxw|last)\.txt", "linux.logons", "last"), (LINUX, r"live/(?:logons_lastb_-Fxw|lastb)\.txt", "linux.logons", "lastb"),
    (LINUX, r"live/journal_sshd\.jsonl", "linux.sshd_journal", ""), (LINUX, r"artifacts/users/etc/passwd", "linux.passwd", ""),
    (LINUX, r"artifacts/cron/.*", "linux.cron_lines", ""), (LINUX, r"artifacts/ssh/(?:.*/)?authorized_keys[^/]*", "linux.ssh_keys", ""),
    (LINUX, r"artifacts/ssh/(?:.*/)?known_hosts[^/]*", "linux.ssh_hosts", ""), (LINUX, r"artifacts/ssh/.*", "linux.ssh_config", ""),
    (LINUX, r"artifacts/shell_history/.*", "linux.shell_history", ""), (LINUX, r"artifacts/disk/fstab", "linux.fstab", ""),
    (LINUX, r"artifacts/mounts/exports", "linux.exports", ""), (LINUX, r"live/kernel_lsmod\.txt", "linux.modules", ""),
    (LINUX, r"live/suid_binaries\.txt", "linux.suid", ""), (LINUX, r"live/sgid_binaries\.txt", "linux.sgid", ""),
    (LINUX, r"live/shm_segments\.txt", "linux.shared_memory", ""), (LINUX, r"live/environment\.txt", "linux.environment", ""),
    (MACOS, r"live/sfltool_dumpbtm\.txt", "macos.background_items", ""), (MACOS, r"live/launchctl_list\.txt", "macos.launchd_services", ""),
    (MACOS, r"live/unified_log_recent\.ndjson", "macos.unified_log", ""), (MACOS, r"artifacts/shell_history/.*", "macos.shell_history", ""),
    (MACOS, r"artifacts/ssh/(?:.*/)?authorized_keys[^/]*", "macos.ssh_keys", ""), (MACOS, r"artifacts/ssh/(?:.*/)?known_hosts[^/]*", "macos.ssh_hosts", ""),
    (MACOS, r"artifacts/ssh/.*", "macos.ssh_config", ""),
    (ESXI, r"live/process_list\.txt", "esxi.processes", ""), (ESXI, r"live/vmlist\.txt", "esxi.vm_list", ""),
    (ESXI, r"live/last\.txt", "esxi.logons", "last"), (ESXI, r"live/who\.txt", "esxi.logons", "who"),
    (ESXI, r"live/(?:environment|printenv)\.txt", "esxi.environment", ""), (ESXI, r"artifacts/ssh/(?:.*/)?authorized_keys[^/]*", "esxi.ssh_keys", ""),
    (ESXI, r"artifacts/ssh/.*", "esxi.ssh_config", ""),
    (WINDOWS, r"live/filesystem\.jsonl", "live.filesystem", ""), (WINDOWS, r"artifacts/(?:.*/)?ConsoleHost_history\.txt", "powershell_history", ""),
]
#: Lines that are JSON objects; files whose whole text is one record (kind, name).
JSON_LINES = ["linux.sshd_journal", "macos.unified_log", "live.filesystem"]
TEXTS = [
    (LINUX, r"live/firewall_iptables-save\.txt", "linux.firewall", "iptables"), (LINUX, r"live/firewall_ip6tables-save\.txt", "linux.firewall", "ip6tables"),
    (LINUX, r"live/firewall_nft_list_ruleset\.txt", "linux.firewall", "nftables"),
    (LINUX, r"live/firewall_firewall-cmd_--list-all-zones\.txt", "linux.firewall", "firewalld"),
    (LINUX, r"live/firewall_ufw_status_verbose\.txt", "linux.firewall", "ufw"), (LINUX, r"live/ulimit\.txt", "linux.status_texts", "ulimit"),
    (LINUX, r"live/mac_(?:sestatus|getenforce)\.txt", "linux.status_texts", "selinux"),
    (LINUX, r"live/mac_(?:aa-status|apparmor_status)\.txt", "linux.status_texts", "apparmor"),
    *[(ESXI, "live/" + name.replace(".", r"\."), "esxi.system_info", name) for name in SYSTEM_FILES],
    *[(ESXI, "live/" + name.replace(".", r"\."), "esxi.security", name) for name in SECURITY_FILES if name not in SYSTEM_FILES],
]
#: What a text record calls its file.
TEXT_NAMES = {"linux.firewall": "label", "linux.status_texts": "kind", "esxi.system_info": "file", "esxi.security": "file"}
TABLES = [(ESXI, rf"live/{name}\.txt", f"esxi.{kind}", "") for name, kind in {
    "esxcli_connection": "connections", "account_list": "accounts", "permission_list": "permissions", "firewall_ruleset_list": "firewall_rulesets",
    "firewall_ruleset_rule_list": "firewall_rules", "storage_filesystem": "filesystems", "software_vib_list": "packages",
    "storage_nmp_device": "multipath_devices", "storage_nmp_path": "multipath_paths", "storage_san_adapter": "fc_adapters",
    "storage_san_iscsi": "iscsi_adapters", "secpolicy_domain": "security_policies", "vmknic_list": "nics", "vmknic_ipv6": "nics_v6",
    "vmknic_portgroup": "port_groups", "wbem_provider_list": "wbem_providers", "hardware_cpu": "cpus", "hardware_pci": "pci_devices"}.items()]
#: JSON files of records, and bags of texts: in a bag, `key` alone is taken out.
RECORDS = [
    *[(WINDOWS, rf"live/{kind}\.json", f"live.{kind}", "") for kind in LIVE_KINDS], (LINUX, r"live/processes\.json", "linux.processes", ""),
    (LINUX, r"live/docker_ps_-a\.json", "linux.docker_containers", ""), (LINUX, r"live/docker_images\.json", "linux.docker_images", ""),
    (LINUX, r"live/docker_network_ls\.json", "linux.docker_networks", ""), (LINUX, r"live/docker_volume_ls\.json", "linux.docker_volumes", ""),
]
BAGS = [
    (LINUX, r"live/system_info\.json", "linux.system_info", ""), (LINUX, r"live/docker_info\.json", "linux.docker_info", ""),
    (LINUX, r"live/packages\.json", "linux.packages", "managers"), (MACOS, r"live/system_info\.json", "macos.system_info", ""),
    (MACOS, r"live/timemachine\.json", "macos.backups", ""),
]
BAG_LINES = [
    (r"live/processes\.json", "macos.processes", ["ps_auxwwe"]), (r"live/network\.json", "macos.netstat", ["netstat_-an", "netstat_an"]),
    (r"live/network\.json", "macos.open_sockets", ["lsof_-i", "lsof_-nP_-i", "lsof_i"]), (r"live/firewall\.json", "macos.firewall_apps", ["alf_listapps"]),
    (r"live/users\.json", "macos.users", ["dscacheutil_users"]), (r"live/applications\.json", "macos.receipts", ["pkgutil_pkgs"]),
    (r"live/applications\.json", "macos.install_history", ["install_history", "installhistory"]),
]
#: Files of which place, size and time are the record.
FILES = [
    (LINUX, r"artifacts/systemd/.*", "linux.units", ""), (LINUX, r"artifacts/persistence/.*", "linux.persistence", ""),
    (LINUX, r"artifacts/cron/.*", "linux.cron_files", ""), (MACOS, r"artifacts/persistence/.*", "macos.persistence", ""),
    (MACOS, r"artifacts/applications/.*", "macos.app_bundles", ""), (MACOS, r"artifacts/recent_items/.*", "macos.recent_items", ""),
    (ESXI, r"artifacts/persistence/.*", "esxi.persistence", ""),
]
PROCESS_FIELDS = ["World ID", "Process ID", "VMX Cartel ID", "UUID", "Display Name", "Config File", "Name", "Type", "User", "Cartel ID"]
TEXT_FOLDERS = "{live,artifacts/cron,artifacts/ssh,artifacts/shell_history,artifacts/users,artifacts/disk,artifacts/mounts,artifacts/PowerShell}"
FILE_FOLDERS = "{artifacts/systemd,artifacts/persistence,artifacts/cron,artifacts/applications,artifacts/recent_items}"
# ------------------------------------------------------------ end fixed values

#: Names that do not end in .json, said as a glob.
NOT_JSON = "{*[!n],*[!o]n,*[!s]on,*[!j]son,*[!.]json}"


@dataclass
class Captures:
    spark: SparkSession
    root: str
    manifests: DataFrame

    def place(self) -> Column:
        """The file's path below its capture."""
        return F.regexp_extract("file", r"/((?:live|artifacts|sections)/.*)$", 1)

    def routed(self, rows: DataFrame, routes: list[tuple]) -> DataFrame:
        """Rows with capture keys, `kind` and `source`; files that feed nothing go."""
        chain = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("source")))
        for platform, place, kind, mark in routes:
            chain = chain.when((F.col("platform") == platform) & F.col("_place").rlike(f"^{place}$"), F.struct(F.lit(kind).alias("kind"), F.lit(mark).alias("source")))
        facts = self.manifests.select("upload_id", "site_id", "host_name", "collection_ts", "platform")
        return rows.join(facts, "upload_id").withColumn("_place", self.place()).withColumn("_to", chain).where(F.col("_to").isNotNull()).select(
            "*", "_to.kind", "_to.source").drop("_to", "_place", "platform")

    def staged(self, rows: DataFrame, name: str) -> DataFrame:
        """`rows` as a table with a partition per kind, in the shared folder."""
        path = shared_folder(self.spark, name)
        rows.write.partitionBy("kind").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _below(rel: str) -> Column:
    return F.regexp_replace(F.regexp_extract("file", r"/artifacts/(.*)$", 1), f"^{rel}/", "")


def _has(spark: SparkSession, pattern: str) -> bool:
    """Whether any file lies under the glob."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def capture_frames(spark: SparkSession, root: str, site_id: str = "") -> dict[str, DataFrame]:
    """Record and line frames of all captures below `root`, by builder kind."""
    captures = Captures(spark, root, read_manifests(spark, f"{root}/*/manifest.json", site_id))
    frames: dict[str, DataFrame] = {}
    texts, files = f"{root}/*/{TEXT_FOLDERS}", f"{root}/*/{FILE_FOLDERS}"
    if _has(spark, texts):
        _text_frames(captures, texts, frames)
        _json_frames(captures, f"{root}/*/live", frames)
    if _has(spark, files):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files).select(
            upload_of(F.col("path")).alias("upload_id"), F.col("path").alias("file"), F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"), F.xxhash64("path").alias("seq"))
        rows = captures.staged(captures.routed(raw, FILES).withColumn("rel", _below(r"(?:systemd|persistence|cron|applications|recent_items)")), "capture-files")
        no_record = F.expr("cast(map() as map<string,string>)")
        frames |= {kind: rows.where(F.col("kind") == kind).drop("kind").withColumn("rec", no_record) for kind in _kinds(FILES)}
    if _has(spark, f"{root}/*/sections"):
        frames |= _section_frames(captures, f"{root}/*/sections")
    return frames


def _kinds(routes: list[tuple]) -> list[str]:
    return list(dict.fromkeys(r[2] for r in routes))


def _text_frames(captures: Captures, paths: str, frames: dict[str, DataFrame]) -> None:
    spark = captures.spark
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", NOT_JSON)
    lines = read_lines(spark, paths, reader=reader)
    # Text routes first: a file is one thing.
    rows = captures.staged(captures.routed(lines, TEXTS + TABLES + LINES), "capture-lines")
    of = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    rel = _below("(?:cron|ssh|shell_history)")
    for kind in _kinds(LINES):
        frame = of(kind).withColumn("rel", F.when(F.col("file").contains("/artifacts/"), rel).otherwise(F.col("rel")))
        if kind in JSON_LINES:
            frame = frame.where(F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull()).withColumn("rec", parse_map(F.col("line")))
        elif kind == "esxi.processes":
            keys = ["upload_id", "site_id", "host_name", "collection_ts", "file"]
            told = blocks(frame, keys, F.trim("line") == "").withColumn("block", F.coalesce("block", F.lit(0)))
            frame = block_records(told, keys, PROCESS_FIELDS).withColumn("seq", F.col("block").cast("long"))
        else:
            frame = frame.withColumn("rec", F.expr("cast(map() as map<string,string>)"))
        frames[kind] = frame
    for kind in _kinds(TEXTS):
        whole = of(kind).groupBy(*KEYS[:-1], "file", "source").agg(F.min("seq").alias("seq"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        frames[kind] = whole.withColumn("rec", F.create_map(F.lit(TEXT_NAMES[kind]), F.col("source"), F.lit("text"), F.col("text"))).drop("text")
    # One file of these serves two builders.
    frames["esxi.security"] = frames["esxi.system_info"].unionByName(frames["esxi.security"])
    frames |= {kind: dash_rows(of(kind)) for kind in _kinds(TABLES)}


def _json_frames(captures: Captures, paths: str, frames: dict[str, DataFrame]) -> None:
    spark = captures.spark
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(paths)
    path = F.col("_metadata.file_path")
    texts = raw.select(upload_of(path).alias("upload_id"), path.alias("file"), F.xxhash64(path).alias("_at"), F.trim(F.make_valid_utf8("value")).alias("text"))
    bag_texts = [(MACOS, place, kind, "") for place, kind, _ in BAG_LINES]
    routes = RECORDS + BAGS + [(MACOS, r"live/firewall\.json", "macos.firewall", "")]
    one = captures.routed(texts, routes).withColumn("_own", F.lit(True))
    # A bag may feed several builders of lines beside its own.
    for route in bag_texts:
        one = one.unionByName(captures.routed(texts, [route]).withColumn("_own", F.lit(False)))
    many = F.col("kind").isin(_kinds(RECORDS))
    array = F.when(F.col("text").startswith("["), parse_maps(F.col("text")))
    listed = F.transform(F.split("text", "\r?\n"), lambda t: F.when(F.ltrim(t).startswith("{"), parse_map(t)))
    items = F.when(many, F.filter(F.coalesce(array, listed), lambda m: m.isNotNull())).otherwise(F.array_compact(F.array(parse_map(F.col("text")))))
    rows = captures.staged(one.select(*KEYS[:-1], "kind", "source", "file", F.posexplode(items).alias("pos", "rec"), "_at").withColumn(
        "seq", F.col("_at") + F.col("pos")).drop("_at", "pos"), "capture-records")
    of = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    frames |= {kind: of(kind) for kind in _kinds(RECORDS + BAGS) if kind != "linux.packages"}
    firewall = of("macos.firewall")
    frames["macos.firewall"] = firewall.select(*KEYS, F.explode("rec").alias("key", "text")).withColumn(
        "rec", F.create_map(F.lit("key"), F.col("key"), F.lit("text"), F.col("text"))).drop("key", "text")
    for _, kind, names in BAG_LINES:
        text = F.coalesce(*[F.when(F.col("rec")[n] != "", F.col("rec")[n]) for n in names])
        frames[kind] = _lines_of(of(kind).withColumn("text", text).where(F.col("text").isNotNull()))
    managers = of("linux.packages").select(*KEYS, "file", F.explode(parse_maps(F.col("rec")["managers"])).alias("m")).select(
        *KEYS, F.concat("file", F.lit("#"), F.col("m")["manager"]).alias("file"), F.col("m")["manager"].alias("manager"), F.coalesce(F.col("m")["raw"], F.lit("")).alias("text"))
    frames["linux.packages"] = _lines_of(managers)


def _lines_of(texts: DataFrame) -> DataFrame:
    """Texts that a record holds -> line frame."""
    return texts.select("*", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).withColumns(
        {"line_no": F.col("pos") + 1, "rec": F.expr("cast(map() as map<string,string>)")}).drop("pos", "text")


def _section_frames(captures: Captures, paths: str) -> dict[str, DataFrame]:
    spark, path = captures.spark, F.col("_metadata.file_path")
    raw = spark.read.option("recursiveFileLookup", True).text(paths).select(
        upload_of(path).alias("upload_id"), path.alias("file"), F.monotonically_increasing_id().alias("seq"), F.trim(F.make_valid_utf8("value")).alias("line"))
    bodies = raw.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()).select(
        "upload_id", "file", "seq", F.explode(parse_map(F.col("line"))).alias("kind", "body")).where(F.col("kind").isin(SECTION_KINDS))
    records = with_captures(bodies.withColumn("rec", parse_map(F.col("body"))).where(F.col("rec").isNotNull()).drop("body"), captures.manifests)
    rows = captures.staged(records, "capture-sections")
    return {f"section.{kind}": rows.where(F.col("kind") == kind).drop("kind") for kind in SECTION_KINDS}


def capture_events(spark: SparkSession, root: str, site_id: str = "") -> DataFrame:
    """All events of the captures below `root`, deduplicated."""
    frames = capture_frames(spark, root, site_id)
    return run_all({kind: frame for kind, frame in frames.items() if kind in BUILDERS})
