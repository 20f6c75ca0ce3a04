"""Dashboard counters, logon and directory summaries, remote-access tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.times import iso_ms
from siftline.functions.values import any_of, whole_number
from siftline.operators.filters import NOTABLE, attr

LOGON_EVENTS = ["windows_logon", "windows_authentication", "windows_rdp", "session_logon"]
FILE_EVENTS = ["file_timeline", "file_timeline_fn"]

# ---------------------------------------------------------------- fixed values
REMOTE_TOOLS: list[tuple[str, str, list[str]]] = [
    ("TeamViewer", "Commercial RMM", ["teamviewer"]),
    ("AnyDesk", "Commercial RMM", ["anydesk"]),
    ("ConnectWise/ScreenConnect", "Commercial RMM", ["screenconnect", "connectwise"]),
    ("BeyondTrust/Bomgar", "Commercial RMM", ["bomgar", "beyondtrust", "beyondtrustcloud"]),
    ("LogMeIn", "Commercial RMM", ["logmein", "logme.in"]),
    ("Splashtop", "Commercial RMM", ["splashtop"]),
    ("GoTo/GoToAssist", "Commercial RMM", ["gotoassist", "gotomypc", "gotoopener"]),
    ("Dameware", "Commercial RMM", ["dameware"]),
    ("RemotePC", "Commercial RMM", ["remotepc"]),
    ("Atera", "Commercial RMM", ["atera"]),
    ("NinjaRMM", "Commercial RMM", ["ninjarmm", "ninjaone"]),
    ("Supremo", "Commercial RMM", ["supremo"]),
    ("RustDesk", "Open Source Remote", ["rustdesk"]),
    ("MeshAgent/MeshCentral", "Open Source Remote", ["meshagent", "meshcentral"]),
    ("VNC (various)", "Open Source Remote", ["vnc", "tightvnc", "ultravnc", "realvnc", "turbovnc"]),
    ("Ammyy Admin", "Dual-Use / Suspicious", ["ammyy"]),
    ("FleetDeck", "Dual-Use / Suspicious", ["fleetdeck"]),
    ("Action1", "Dual-Use / Suspicious", ["action1"]),
    ("SimpleHelp", "Dual-Use / Suspicious", ["simplehelp"]),
    ("Radmin", "Legacy Remote", ["radmin"]),
    ("NetSupport", "Dual-Use / Suspicious", ["netsupport"]),
    ("Ngrok", "Tunneling", ["ngrok"]),
    ("Cloudflared Tunnel", "Tunneling", ["cloudflared"]),
    ("Tailscale", "VPN/Mesh", ["tailscale"]),
    ("ZeroTier", "VPN/Mesh", ["zerotier"]),
    ("WireGuard", "VPN/Mesh", ["wireguard"]),
    ("psexec", "Lateral Movement", ["psexec"]),
    ("Windows Remote Desktop (mstsc)", "Built-in Remote", ["mstsc"]),
    ("Windows Remote Assistance", "Built-in Remote", ["msra.exe", "remote assistance"]),
    ("Quick Assist", "Built-in Remote", ["quickassist"]),
]
RISKY_CATEGORIES = ["Dual-Use / Suspicious", "Tunneling", "Lateral Movement"]
NOISY_EVENTS = ["file_timeline", "file_timeline_fn", "srum_app_usage", "srum_network_connectivity"]
# ------------------------------------------------------------ end fixed values


def counters(df: DataFrame) -> DataFrame:
    """Total, notable and suspicious events in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("ct_significance") == NOTABLE).alias("notable_count"),
        F.count_if(F.col("is_suspicious")).alias("suspicious_count"),
    )


def count_by(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def logon_summary(df: DataFrame) -> DataFrame:
    """Per user: events, successes, failures, addresses, first and last time,
    packages, logon types, domain."""
    def usable(name: str, *skip: str) -> Column:
        col = attr(df, name)
        return F.when(~col.isin("", *skip), col)

    def joined(name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(usable(name))), ", ")

    event_id = attr(df, "event_identifier")
    user = F.coalesce(attr(df, "TargetUserName"), attr(df, "User"), F.lit("unknown"))
    return (
        df.where(F.col("event_type").isin(LOGON_EVENTS))
        .groupBy(user.alias("username"))
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(event_id == "4624").alias("success_count"),
            F.count_if(event_id == "4625").alias("fail_count"),
            F.count_distinct(usable("IpAddress", "-")).alias("unique_ips"),
            iso_ms(F.min("datetime")).alias("first_seen"),
            iso_ms(F.max("datetime")).alias("last_seen"),
            joined("AuthenticationPackageName").alias("auth_packages"),
            joined("LogonType").alias("logon_types"),
            F.max(usable("TargetDomainName", "-")).alias("domain"),
        )
    )


def _directory(path: str) -> str:
    path = (path or "/").lower()
    return path if path.endswith("/") else path + "/"


def files_in(df: DataFrame, path: str | None = None) -> DataFrame:
    """Files of a directory (or, without a path, of every directory) with their
    largest size, latest time, hashes and flags."""
    def given(name: str) -> Column:
        return F.when(attr(df, name) != "", attr(df, name))

    files = df.where(F.col("event_type").isin(FILE_EVENTS)).where(F.coalesce(attr(df, "meta_type") != "Dir", F.lit(True)))
    keys = [attr(df, "file_name").alias("name")]
    if path is None:
        keys.insert(0, attr(df, "file_path").alias("dir"))
    else:
        files = files.where(attr(df, "file_path") == _directory(path))
    return files.groupBy(*keys).agg(
        F.max(whole_number(given("file_size"))).alias("size"),
        iso_ms(F.max("datetime")).alias("latest_time"),
        F.max(given("md5")).alias("md5"),
        F.max(given("sha256")).alias("sha256"),
        F.bool_or(F.coalesce(F.lower(attr(df, "is_deleted")) == "true", F.lit(False))).alias("is_deleted"),
        F.bool_or(F.coalesce(attr(df, "timestompNote") != "", F.lit(False))).alias("has_timestomp"),
        F.max(F.when(F.col("ct_significance") != "", F.col("ct_significance"))).alias("significance"),
        F.bool_or("is_suspicious").alias("is_suspicious"),
    )


def directories_in(df: DataFrame, path: str = "/") -> DataFrame:
    """Sub-directories of a directory; of the root, the drives."""
    files = df.where(F.col("event_type").isin(FILE_EVENTS))
    if _directory(path) == "/":
        return drives(df)
    return (
        files.where((attr(df, "file_path") == _directory(path)) & (attr(df, "meta_type") == "Dir"))
        .select(attr(df, "file_name").alias("name")).where(F.col("name") != "").distinct()
    )


def drives(df: DataFrame) -> DataFrame:
    letter = F.regexp_extract(attr(df, "file_path"), "^/([a-z])/$", 1)
    return (
        df.where(F.col("event_type").isin(FILE_EVENTS)).select(letter.alias("name")).where(F.col("name") != "").distinct()
    )


def list_directory(df: DataFrame, path: str = "/") -> DataFrame:
    """Directories first, then files, each by name."""
    folders = directories_in(df, path).select("name", F.lit(True).alias("is_dir"))
    files = files_in(df, path).withColumn("is_dir", F.lit(False))
    return folders.unionByName(files, allowMissingColumns=True).orderBy(F.desc("is_dir"), "name")


def remote_tool(message: Column) -> Column:
    """Index of the first tool in list order one of whose terms occurs in the
    message; NULL when none does."""
    text = F.lower(message)
    chain = F.when(F.lit(False), F.lit(0))
    for i, (_, _, terms) in enumerate(REMOTE_TOOLS):
        chain = chain.when(any_of([text.contains(t) for t in terms]), F.lit(i))
    return chain


def remote_access(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Remote-access tools seen: events, distinct event types, first and last
    time per tool (and per `keys`, such as upload_id)."""
    keys = keys or []
    # One test for any term at all lets most events skip the ordered chain.
    anything = "|".join(t.replace(".", r"\.") for _, _, terms in REMOTE_TOOLS for t in terms)
    hits = df.where(
        ~F.col("event_type").isin(NOISY_EVENTS) & F.lower("message").rlike(anything)
    ).select(*keys, "event_type", "datetime", remote_tool(F.col("message")).alias("tool"))
    found = hits.groupBy(*keys, "tool").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
        F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"),
    )

    def fact(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("tool"))

    terms = F.get(F.array(*[F.array(*[F.lit(t) for t in ts]) for _, _, ts in REMOTE_TOOLS]), F.col("tool"))
    return found.select(
        *keys, fact([n for n, _, _ in REMOTE_TOOLS]).alias("tool_name"),
        fact([c for _, c, _ in REMOTE_TOOLS]).alias("category"), "event_count", "event_types", "first_seen",
        "last_seen", terms.alias("search_terms"),
    )


def remote_headline(tools: DataFrame, category: str = "") -> DataFrame:
    """Tools, events and risky tools found."""
    if category:
        tools = tools.where(F.col("category") == category)
    return tools.agg(
        F.count(F.lit(1)).alias("total_tools"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
        F.count_if(F.col("category").isin(RISKY_CATEGORIES)).alias("suspicious_count"),
    )


def platform_summary(uploads: DataFrame) -> DataFrame:
    """Completed captures and their events per platform."""
    return (
        uploads.where(F.col("status") == "complete")
        .groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform"))
        .agg(
            F.count_distinct("upload_id").alias("upload_count"),
            F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"),
        )
    )


def site_list(sites: DataFrame, uploads: DataFrame, events: DataFrame) -> DataFrame:
    """Sites with their captures and events; both sides are counted first, so
    the joins only see one row per site."""
    captures = uploads.groupBy("site_id").agg(F.count(F.lit(1)).alias("upload_count"))
    counted = events.groupBy("site_id").agg(F.count(F.lit(1)).alias("event_count"))
    return (
        sites.join(captures, "site_id", "left").join(counted, "site_id", "left")
        .withColumn("upload_count", F.coalesce("upload_count", F.lit(0)))
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    )


def close_out(df: DataFrame) -> DataFrame:
    """Per capture: event count and first non-empty host in source order."""
    host = F.min_by("host_name", F.when(F.col("host_name") != "", F.col("seq")))
    return df.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.coalesce(host, F.lit("")).alias("host_name")
    )


def quality_check(raw: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Timeline lines (`line`): how many, how many are not JSON objects, and how
    many lack each required field. Every line is read."""
    required = required or ["datetime", "timestamp_desc", "message"]
    parsed = raw.select("line", F.from_json("line", "map<string,string>").alias("m"), F.try_parse_json("line").isNull().alias("bad"))
    lines = F.trim("line") != ""
    return parsed.where(lines).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("invalid_json"),
        *[
            F.count_if(~F.col("bad") & (F.coalesce(F.col("m")[n], F.lit("")) == "")).alias(f"missing_{n}")
            for n in required
        ],
    )
