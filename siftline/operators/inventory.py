"""Policy-share, collected-file and software reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.values import once, whole_number
from siftline.functions.times import install_date, iso_ms
from siftline.operators.filters import attr, contains_ci
from siftline.operators.paging import first_children

#: Reports stand for one capture: equal paths of two hosts are two files.
CAPTURE = ["upload_id"]
FILE_DATA = "fs:stat:ntfs:"
POLICY_SHARE = "SYSVOL"
POLICY_PATTERN = r"(?i)/Policies/(\{[A-F0-9-]+\})/"
KEY_FILES = ["gpt.ini", "registry.pol", "machine", "user"]


def either(df: DataFrame, *names: str) -> Column:
    """First non-empty of the spellings old and new exports use for a field."""
    return F.coalesce(*[F.when(attr(df, n) != "", attr(df, n)) for n in names])


# ------------------------------------------------------------- policy share

def policy_entries(df: DataFrame) -> DataFrame:
    """File events on the policy share: path, name, size, kind of time."""
    path = either(df, "filePath", "file_path")
    # Else the path, and the bag it comes from, would be worked out at each mention.
    files = df.where(F.startswith("data_type", F.lit(FILE_DATA))).withColumn("_path", once(path))
    path = F.col("_path")
    return files.where(contains_ci(path, POLICY_SHARE)).select(
        "id", "upload_id", path.alias("path"), either(df, "fileName", "file_name").alias("name"),
        either(df, "fileSize", "file_size").alias("size"), "datetime", "timestamp_desc",
        F.when(path.rlike(POLICY_PATTERN), F.regexp_extract(path, POLICY_PATTERN, 1)).alias("policy"),
    )


def ancestors(entries: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """(dir, child) for every directory on every path of a capture (`keys`).

    Paths are made distinct first and then give all their levels, so the entries are read
    once and a row costs no more than its path.
    """
    paths = entries.where(F.contains("path", F.lit("/"))).select(*keys, "path").distinct()
    parts = F.split("path", "/")

    def prefix(i: Column) -> Column:
        return F.array_join(F.slice(parts, F.lit(1), i), "/")

    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(prefix(i).alias("dir"), prefix(i + 1).alias("child")))
    return paths.select(*keys, F.inline(steps)).where(F.col("dir") != "").distinct()


def policy_totals(entries: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """Entries, distinct paths, policies and directories of a capture, in one
    aggregation."""
    rows = entries.select(*keys, "path", "policy", F.lit(None).cast("string").alias("dir")).unionByName(
        ancestors(entries, keys).select(*keys, "dir").distinct(), allowMissingColumns=True
    )
    return rows.groupBy(*keys).agg(
        F.count("path").alias("entries"), F.count_distinct("path").alias("paths"),
        F.count_distinct("policy").alias("policies"), F.count("dir").alias("directories"),
    )


def policies(entries: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """Per policy of a capture (`keys`): files, key files, earliest creation, latest change."""
    desc, name = F.col("timestamp_desc"), F.lower(F.coalesce("name", F.lit("")))
    key = F.lit(False)
    for k in KEY_FILES:
        key = key | name.contains(k)
    return entries.where(F.col("policy").isNotNull()).groupBy(*keys, "policy").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(key).alias("key_files"),
        iso_ms(F.min(F.when(desc.contains("Created"), F.col("datetime")))).alias("created"),
        iso_ms(F.max(F.when(desc.contains("Modified") | desc.contains("Changed"), F.col("datetime")))).alias("modified"),
    )


def policy_facets(entries: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """Counts per file extension and per kind of timestamp of a capture."""
    name = F.coalesce(F.col("name"), F.lit(""))
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    facet = F.array(
        F.struct(F.lit("time").alias("facet"), F.col("timestamp_desc").alias("value")),
        F.struct(
            F.lit("extension").alias("facet"),
            F.when(name == "", F.lit(None)).when(ext == "", F.lit("(no extension)")).otherwise(ext).alias("value"),
        ),
    )
    return entries.select(*keys, F.inline(facet)).where(F.col("value").isNotNull()).groupBy(*keys, "facet", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def policy_tree(entries: DataFrame, n: int = 3, keys: list[str] = CAPTURE) -> DataFrame:
    return first_children(ancestors(entries, keys), n, keys)


# ---------------------------------------------------------- collected files

def collected_files(df: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """One row per collected path of a capture (`keys`): earliest creation, latest other times (only
    content times), and the details of its first record in source order."""
    path = either(df, "filePath", "file_path", "path")
    status = either(df, "fileContentStatus", "file_content_status")
    details = F.struct(
        either(df, "fileName", "file_name", "name").alias("file_name"), either(df, "fileSize", "file_size").alias("file_size"),
        either(df, "md5hash", "md5").alias("md5"), either(df, "sha1hash", "sha1").alias("sha1"),
        either(df, "sha256hash", "sha256").alias("sha256"), either(df, "metaDataAddr", "meta_data_addr").alias("mft_entry"),
        status.alias("content_status"), either(df, "metaType", "meta_type").alias("meta_type"),
        either(df, "userSID", "user_sid").alias("user_sid"),
    )
    rows = df.where(F.startswith("data_type", F.lit(FILE_DATA)) & (status == "Collected") & path.isNotNull()).select(
        *keys, path.alias("file_path"), "seq", "datetime", details.alias("d"), time_kind(F.col("timestamp_desc")).alias("kind")
    )

    def of(kind: str, agg) -> Column:
        return iso_ms(agg(F.when(F.col("kind") == kind, F.col("datetime"))))

    return rows.groupBy(*keys, "file_path").agg(
        F.min_by("d", "seq").alias("d"), of("Created", F.min).alias("date_created"),
        *[of(k, F.max).alias(f"date_{k.lower()}") for k in ("Modified", "Accessed", "Changed")],
    ).select(*keys, "file_path", "d.*", "date_created", "date_modified", "date_accessed", "date_changed")


def time_kind(desc: Column) -> Column:
    """First of Created, Modified, Accessed, Changed in the description; name
    times do not count."""
    chain = F.when(desc.endswith("($FN)"), F.lit(None).cast("string"))
    for kind in ("Created", "Modified", "Accessed", "Changed"):
        chain = chain.when(desc.contains(kind), F.lit(kind))
    return chain


def collected_summary(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count("date_created").alias("with_created"),
        F.count("date_modified").alias("with_modified"),
        F.coalesce(F.sum(whole_number(F.col("file_size"))), F.lit(0)).alias("total_size"),
        F.count_if(F.coalesce("md5", "sha1", "sha256").isNotNull()).alias("with_hash"),
    )


# ------------------------------------------------------------------ software

SOFTWARE_FIELDS = {
    "program_name": [], "publisher": ["publisher"], "version": ["version"],
    "install_source": ["install_source"], "install_path": ["install_path", "rootDirPath"],
    "uninstall_string": ["uninstall_string", "uninstallString"],
    "registry_key_path": ["registry_key_path", "registryKeyPath"],
    "msi_product_code": ["msi_product_code", "msiProductCode"],
    "msi_package_code": ["msi_package_code", "msiPackageCode"], "hidden_from_arp": ["hidden_from_arp", "hiddenArp"],
    "is_inbox_app": ["is_inbox_app", "isInboxApp"], "store_app_type": ["store_app_type", "storeAppType"],
    "package_full_name": ["package_full_name", "packageFullName"],
}


def software_inventory(df: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    """Installed software of a capture (`keys`) out of registry and inventory events.

    Key of an entry: product code, else name and publisher. Registry rows create an entry
    and fill an empty name or publisher; inventory rows override with what they
    have. `Both` needs the first registry row before an inventory row.
    """
    registry = (F.col("data_type") == "windows:registry:uninstall") | (F.col("event_type") == "registry_software")
    listed = (F.col("data_type") == "windows:registry:amcache:inventory_application") | (
        F.col("event_type") == "installed_program"
    )
    code = F.lower(either(df, "msi_product_code", "msiProductCode"))
    named = F.lower(F.trim(F.coalesce(either(df, "program_name", "software_name", "name"), F.lit(""))))
    by = F.lower(F.trim(F.coalesce(either(df, "publisher"), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("msi:"), code), F.concat(F.lit("name:"), named, F.lit("|publisher:"), by))
    rows = df.where(registry | listed).select(
        *keys, key.alias("key"), "seq", registry.alias("reg"),
        F.when(registry, either(df, "software_name", "program_name")).otherwise(either(df, "program_name")).alias("program_name"),
        *[either(df, *names).alias(out) for out, names in SOFTWARE_FIELDS.items() if names],
        F.coalesce(
            F.when(~registry & either(df, "install_date", "installDate", "msiInstallDate").isNotNull(),
                   F.date_format(install_date(either(df, "install_date", "installDate", "msiInstallDate")), "yyyy-MM-dd'T'HH:mm:ss")),
            F.when(registry | either(df, "install_date", "installDate", "msiInstallDate").isNull(), iso_ms(F.col("datetime"))),
        ).alias("install_date"),
        iso_ms(F.col("datetime")).alias("timestamp"), F.col("host_name").alias("hostname"),
    )
    seq, reg = F.col("seq"), F.col("reg")
    merged = rows.groupBy(*keys, "key").agg(
        F.min(F.when(reg, seq)).alias("first_reg"), F.min(F.when(~reg, seq)).alias("first_inv"),
        *[_merged(c) for c in (*SOFTWARE_FIELDS, "timestamp", "hostname", "install_date")],
    )
    created_by_registry = F.col("first_inv").isNull() | F.coalesce(F.col("first_reg") < F.col("first_inv"), F.lit(False))
    source = (
        F.when(F.col("first_inv").isNull(), F.lit("Registry"))
        .when(created_by_registry, F.lit("Both")).otherwise(F.lit("Amcache"))
    )

    def value(name: str) -> Column:
        parts, default = F.col(f"_{name}"), "False" if name in ("hidden_from_arp", "is_inbox_app") else ""
        if name in ("program_name", "publisher", "install_date"):
            return F.coalesce(parts["inv"], parts["reg_filled"], F.lit(default)).alias(name)
        kept = F.lit("Registry") if name == "install_source" else parts["reg_first"]
        return F.coalesce(parts["inv"], F.when(created_by_registry, kept), F.lit(default)).alias(name)

    names = [*SOFTWARE_FIELDS, "timestamp", "hostname", "install_date"]
    return merged.select(*keys, "key", *[value(n) for n in names], source.alias("data_source"))


def _merged(name: str) -> Column:
    """Last non-empty inventory value; value of the first registry row; first
    non-empty registry value."""
    value, seq, reg = F.col(name), F.col("seq"), F.col("reg")
    return F.struct(
        F.max_by(value, F.when(~reg & value.isNotNull(), seq)).alias("inv"),
        F.min_by(value, F.when(reg, seq)).alias("reg_first"),
        F.min_by(value, F.when(reg & value.isNotNull(), seq)).alias("reg_filled"),
    ).alias(f"_{name}")


def software_summary(report: DataFrame) -> DataFrame:
    def filled(name: str) -> Column:
        return F.count_if(F.col(name) != "")

    return report.groupBy("data_source").agg(
        F.count(F.lit(1)).alias("programs"), filled("version").alias("with_version"),
        filled("install_date").alias("with_install_date"), filled("publisher").alias("with_publisher"),
        filled("msi_product_code").alias("with_product_code"),
    )
