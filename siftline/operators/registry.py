"""Builders over decoded registry values.

`rec` of a row: hive (file name), key_path, key_time (text), value_name,
value_string, value_hex (raw bytes as hex). A key without values comes as one
row with an empty value name. Key paths are compared without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.functions.text import ellipsis, rot13
from siftline.functions.times import event_time, filetime
from siftline.functions.values import any_of
from siftline.operators.build import Emit, build, build_all, builder, opt, rec, say

# ---------------------------------------------------------------- fixed values
USER_RUN_KEYS = [
    r"Software\Microsoft\Windows\CurrentVersion\Run",
    r"Software\Microsoft\Windows\CurrentVersion\RunOnce",
    r"Software\Microsoft\Windows\CurrentVersion\RunServices",
    r"Software\Microsoft\Windows\CurrentVersion\RunServicesOnce",
    r"Software\Microsoft\Windows NT\CurrentVersion\Winlogon\Shell",
]
MACHINE_RUN_KEYS = [
    r"Microsoft\Windows\CurrentVersion\Run",
    r"Microsoft\Windows\CurrentVersion\RunOnce",
    r"Microsoft\Windows\CurrentVersion\RunServices",
    r"Microsoft\Windows\CurrentVersion\RunServicesOnce",
    r"Microsoft\Windows\CurrentVersion\Policies\Explorer\Run",
]
EXPLORER = r"Software\Microsoft\Windows\CurrentVersion\Explorer"
ACTIVITY_MODERATOR_KEYS = [
    r"ControlSet001\Services\bam\State\UserSettings",
    r"ControlSet001\Services\bam\UserSettings",
    r"ControlSet001\Services\dam\State\UserSettings",
    r"ControlSet001\Services\dam\UserSettings",
]
NETWORK_PROFILES = r"Microsoft\Windows NT\CurrentVersion\NetworkList\Profiles"
UNINSTALL = r"Microsoft\Windows\CurrentVersion\Uninstall"
EXCLUSIONS = r"Microsoft\Windows Defender\Exclusions"
WINLOGON = r"Microsoft\Windows NT\CurrentVersion\Winlogon"
AMCACHE_FILES = r"Root\InventoryApplicationFile"
SHELL_BAGS = r"Local Settings\Software\Microsoft\Windows\Shell\BagMRU"
DEFAULT_SHELL = "explorer.exe"
DEFAULT_USERINIT = [
    r"c:\windows\system32\userinit.exe,", "userinit.exe,", r"c:\windows\system32\userinit.exe", "userinit.exe",
]
# ------------------------------------------------------------ end fixed values


def _path() -> Column:
    return F.lower(rec("key_path"))


def at(*paths: str) -> Column:
    """The key itself."""
    return _path().isin([p.lower() for p in paths])


def under(*paths: str, depth: int | None = None) -> Column:
    """A key below one of the paths, `depth` levels down if given."""
    def one(p: str) -> Column:
        lead = p.lower() + "\\"
        inside = _path().startswith(lead)
        if depth is None:
            return inside
        rest = F.expr(f"substring(lower(coalesce(rec['key_path'], '')), {len(lead) + 1})")
        return inside & (F.size(F.split(rest, r"\\")) == depth)

    return any_of([one(p) for p in paths])


def key_name() -> Column:
    return F.substring_index(rec("key_path"), "\\", -1)


def parent_name(levels: int = 1) -> Column:
    return F.substring_index(F.substring_index(rec("key_path"), "\\", -1 - levels), "\\", 1)


def key_time() -> Column:
    ts = event_time(rec("key_time"))
    return F.when(F.year(ts).between(1970, 2100), ts)


def ticks_at(offset: int) -> Column:
    """Little-endian 8-byte tick count at a byte offset of the value."""
    raw = F.substring(rec("value_hex"), offset * 2 + 1, 16)
    swapped = F.concat(*[F.substring(raw, 15 - 2 * i, 2) for i in range(8)])
    ticks = F.conv(swapped, 16, 10).try_cast("long")
    ts = filetime(F.when(F.length(raw) == 16, ticks))
    return F.when(F.year(ts).between(1970, 2100), ts)


def utf16_text() -> Column:
    """UTF-16LE bytes of the value up to the first NUL."""
    raw = F.decode(F.unhex(rec("value_hex")), "UTF-16LE")
    return F.substring_index(raw, "\u0000", 1)


def _registry(event_type: str, data_type: str, desc: str, message: Column, where: Column, **more) -> Emit:
    return Emit(
        event_type=event_type, data_type=data_type, message=message, where=where,
        times=more.pop("times", None) or [(key_time(), desc)],
        source=("CT-Registry", F.concat(F.lit("Registry - "), rec("hive"))), **more,
    )


def per_key(df: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    """One row per key with the named values folded in (as `rec` fields)."""
    keys = ["upload_id", "site_id", "host_name", "collection_ts"]
    name = F.lower(rec("value_name"))
    folded = df.where(where).groupBy(*keys, rec("hive").alias("hive"), rec("key_path").alias("key_path")).agg(
        F.min("seq").alias("seq"), F.max(rec("key_time")).alias("key_time"),
        *[F.max(F.when(name == n.lower(), v)).alias(f"v{i}") for i, (n, v) in enumerate(values.items())],
    )
    flat = [F.lit("hive"), F.col("hive"), F.lit("key_path"), F.col("key_path"), F.lit("key_time"), F.col("key_time")]
    for i, n in enumerate(values):
        flat += [F.lit(n), F.coalesce(F.regexp_replace(F.col(f"v{i}").cast("string"), "\u0000+$", ""), F.lit(""))]
    return folded.select(*keys, "seq", F.create_map(*flat).alias("rec"))


def _text_of(*names: str) -> dict[str, Column]:
    return {n: rec("value_string") for n in names}


@builder("registry.run_keys")
def run_keys(df: DataFrame) -> DataFrame:
    name = rec("value_name")
    return build(df, _registry(
        "startup_item", "windows:registry:run", "Registry Key Modified",
        F.concat(say("Startup item configured: {value_name}"), opt(" ({value_string})")),
        at(*USER_RUN_KEYS, *MACHINE_RUN_KEYS) & (name != "") & (F.lower(name) != "(default)"),
        attrs={
            "config_type": F.lit("Run/RunOnce"), "description": "value_name", "details": "value_string",
            "registry_key": "key_path", "registry_value": "value_name",
        },
    ))


@builder("registry.user_values")
def user_values(df: DataFrame) -> DataFrame:
    """Per-value user activity: executed programs, typed URLs, searches."""
    decoded = rot13(rec("value_name"))
    assist = _registry(
        "registry_userassist", "windows:registry:userassist", "",
        F.concat(F.lit("Program executed (UserAssist): "), decoded),
        under(EXPLORER + r"\UserAssist", depth=2) & (F.lower(key_name()) == "count"),
        times=[(ticks_at(60), "UserAssist Last Execution")], attrs={"value_name": decoded},
    )
    url = rec("value_string")
    typed = _registry(
        "registry_typedurls", "windows:registry:typedurls", "TypedURLs Key Modified",
        ellipsis(F.concat(F.lit("Browser URL typed: "), url), 200),
        at(r"Software\Microsoft\Internet Explorer\TypedURLs") & rec("value_name").startswith("url") & (url != ""),
        attrs={"url": "value_string", "entry_number": "value_name"}, whole=url,
    )
    query = utf16_text()
    searched = _registry(
        "registry_wordwheel", "windows:registry:wordwheel", "Windows Search Query",
        F.concat(F.lit("Search: "), query),
        at(EXPLORER + r"\WordWheelQuery") & ~rec("value_name").isin("MRUListEx", "") & (query != ""),
        attrs={"search_query": query},
    )
    return build_all(df, [assist, typed, searched])


@builder("registry.user_lists")
def user_lists(df: DataFrame) -> DataFrame:
    """Per-key user lists: typed paths, run commands; recent documents."""
    keys = ["upload_id", "site_id", "host_name", "collection_ts"]
    paths_key, run_key = at(EXPLORER + r"\TypedPaths"), at(EXPLORER + r"\RunMRU")
    entries = df.where(
        (rec("value_string") != "")
        & ((paths_key & rec("value_name").startswith("url")) | (run_key & (rec("value_name") != "MRUList")))
    )
    item = F.struct(F.col("seq").alias("s"), F.regexp_replace(rec("value_string"), r"[\\1\u0000]+$", "").alias("run"), rec("value_string").alias("text"))
    folded = entries.groupBy(*keys, rec("hive").alias("hive"), rec("key_path").alias("key_path")).agg(
        F.min("seq").alias("seq"), F.max(rec("key_time")).alias("key_time"), F.array_sort(F.collect_list(item)).alias("items")
    ).withColumn("rec", F.create_map(
        F.lit("hive"), F.col("hive"), F.lit("key_path"), F.col("key_path"), F.lit("key_time"), F.col("key_time"),
    ))
    texts = F.array_join(F.transform("items", lambda i: i["text"]), ", ")
    runs = F.transform("items", lambda i: i["run"])
    recent = df.where(at(EXPLORER + r"\RecentDocs"))
    return build_all(folded, [
        _registry(
            "registry_typedpaths", "windows:registry:typedurls", "TypedPaths Key Modified",
            ellipsis(F.concat(F.lit("Explorer path typed: "), texts), 200), paths_key, attrs={"typed_paths": texts}, whole=texts,
        ),
        _registry(
            "registry_runmru", "windows:registry:mrulist", "RunMRU Key Modified",
            F.concat(F.lit("Run command executed: "), F.get(runs, F.lit(0))), run_key,
            attrs={"commands": F.array_join(runs, ", ")},
        ),
    ]).unionByName(build(recent, _registry(
        "registry_recentdocs", "windows:registry:recentdocs", "RecentDocs Key Modified",
        F.lit("Recent documents accessed"), F.lit(True),
    )))


@builder("registry.shell_bags")
def shell_bags(df: DataFrame) -> DataFrame:
    """Folder keys, at any depth."""
    df = per_key(df, {}, at(SHELL_BAGS) | under(SHELL_BAGS))
    return build(df, _registry(
        "registry_shellbag", "windows:registry:bagmru", "ShellBag Key Modified",
        F.concat(F.lit("Folder accessed (ShellBag): "), key_name()), F.lit(True),
    ))


@builder("registry.sam")
def sam_users(df: DataFrame) -> DataFrame:
    rid = F.coalesce(F.conv(F.regexp_extract(key_name(), "^([0-9A-Fa-f]+)", 1), 16, 10).try_cast("int"), F.lit(0))
    df = per_key(df, {}, under(r"SAM\Domains\Account\Users", depth=1) & (F.lower(key_name()) != "names"))
    return build(df, _registry(
        "registry_sam_user", "windows:registry:sam_users", "SAM User Key Modified",
        say("SAM User account (RID: {r})", r=rid), F.lit(True), attrs={"account_rid": rid},
    ))


@builder("registry.services")
def services(df: DataFrame) -> DataFrame:
    df = per_key(df, _text_of("ImagePath"), under(r"ControlSet001\Services", depth=1))
    return build(df, _registry(
        "registry_service", "windows:registry:services", "Service Key Modified",
        F.concat(F.lit("Service configured: "), key_name()), F.lit(True),
        attrs={"service_name": key_name(), "image_path": "ImagePath"},
    ))


@builder("registry.usb")
def usb_devices(df: DataFrame) -> DataFrame:
    df = per_key(df, {}, under(r"ControlSet001\Enum\USBSTOR", depth=2))
    return build(df, _registry(
        "registry_usb", "windows:registry:usbstor", "USB Device Connected",
        say("USB storage device: {d} (Serial: {s})", d=parent_name(), s=key_name()), F.lit(True),
        attrs={"device_description": parent_name(), "serial_number": key_name()},
    ))


@builder("registry.shim_cache")
def shim_cache(df: DataFrame) -> DataFrame:
    """Decoded cache entries (`rec`: hive, path, modified, key_time)."""
    name = F.substring_index(rec("path"), "\\", -1)
    return build(df, _registry(
        "registry_shimcache", "windows:registry:appcompatcache", "",
        F.concat(F.lit("ShimCache: "), name), F.lit(True),
        times=[(event_time(rec("modified")), "ShimCache Last Modified Time"), (key_time(), "ShimCache Last Modified Time")],
        attrs={"file_path": "path", "file_name": name},
    ))


@builder("registry.activity_moderator")
def activity_moderator(df: DataFrame) -> DataFrame:
    name = F.substring_index(rec("value_name"), "\\", -1)
    return build(df, _registry(
        "registry_bam", "windows:registry:bam", "", F.concat(F.lit("BAM execution: "), name),
        under(*ACTIVITY_MODERATOR_KEYS, depth=1) & ~rec("value_name").isin("Version", "SequenceNumber", ""),
        times=[(ticks_at(0), "BAM Execution Time")],
        attrs={"file_path": "value_name", "file_name": name, "user_sid": key_name()},
    ))


@builder("registry.uninstall")
def uninstall(df: DataFrame) -> DataFrame:
    df = per_key(df, _text_of("DisplayName", "Publisher"), under(UNINSTALL, depth=1))
    name = F.when(rec("DisplayName") != "", rec("DisplayName")).otherwise(key_name())
    return build(df, _registry(
        "registry_software", "windows:registry:uninstall", "Software Installed/Modified",
        F.concat(say("Software: {n}", n=name), opt(" by {Publisher}")), F.lit(True),
        attrs={"software_name": name, "publisher": "Publisher"},
    ))


@builder("registry.networks")
def networks(df: DataFrame) -> DataFrame:
    df = per_key(df, _text_of("ProfileName", "Category"), under(NETWORK_PROFILES, depth=1))
    name = F.when(rec("ProfileName") != "", rec("ProfileName")).otherwise(key_name())
    kind = labels.network_category(F.when(rec("Category") != "", rec("Category")))
    return build(df, _registry(
        "registry_networklist", "windows:registry:network_profile", "Network Profile Modified",
        say("Network profile: {n} ({k})", n=name, k=kind), F.lit(True),
        attrs={"profile_name": name, "category": kind},
    ))


@builder("registry.exclusions")
def exclusions(df: DataFrame) -> DataFrame:
    kinds = [f"{EXCLUSIONS}\\{k}" for k in ("Paths", "Extensions", "Processes")]
    return build(df, _registry(
        "registry_defender_exclusion", "windows:registry:defender_exclusion", "Defender Exclusion Added",
        say("Defender exclusion ({k}): {value_name}", k=key_name()), at(*kinds) & (rec("value_name") != ""),
        attrs={"exclusion_type": F.lower(key_name()), "exclusion_value": "value_name"},
    ))


def unusual_logon_program(value_name: Column, value: Column) -> Column:
    """Shell or userinit set to anything but its default."""
    text = F.lower(F.trim(value))
    return F.when(F.lower(value_name) == "shell", text != DEFAULT_SHELL).otherwise(~text.isin(DEFAULT_USERINIT))


@builder("registry.winlogon")
def winlogon(df: DataFrame) -> DataFrame:
    odd = unusual_logon_program(rec("value_name"), rec("value_string"))
    name = F.initcap(rec("value_name"))
    return build(df, _registry(
        "registry_winlogon", "windows:registry:winlogon", "Winlogon Key Modified",
        F.concat(say("Winlogon {n}: {value_string}", n=name), F.when(odd, F.lit(" [SUSPICIOUS]")).otherwise(F.lit(""))),
        at(WINLOGON) & F.lower(rec("value_name")).isin("shell", "userinit") & (rec("value_string") != ""),
        attrs={"value_name": name, "value_data": "value_string", "is_suspicious": odd}, suspicious=odd,
    ))


@builder("registry.amcache")
def amcache(df: DataFrame) -> DataFrame:
    df = per_key(df, _text_of("Name"), under(AMCACHE_FILES, depth=1))
    name = F.when(rec("Name") != "", rec("Name")).otherwise(key_name())
    return build(df, _registry(
        "registry_amcache", "windows:registry:amcache", "Amcache Entry Created",
        F.concat(F.lit("Program evidence (Amcache): "), name), F.lit(True), attrs={"program_name": name},
    ))
