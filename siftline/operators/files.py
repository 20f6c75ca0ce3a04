"""File timelines: MACB unpivots, MFT records and paths, listing fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import base_name, one_decimal, parent_dir
from siftline.functions.times import epoch_ms, event_time, filetime
from siftline.functions.values import parse_map, whole_number
from siftline.operators.build import Emit, build, builder, rec, say, word
from siftline.operators.sections import with_analysis
from siftline.session import cut_lineage

# ---------------------------------------------------------------- fixed values
SI_TYPE = "fs:stat:ntfs:$standard_information"
FN_TYPE = "fs:stat:ntfs:$file_name"
TIMESTOMP_NOTE = "Compare with SI timestamps for timestomping detection"
TIME_KINDS = [
    ("modified", "File Modified"), ("created", "File Created"),
    ("accessed", "File Accessed"), ("changed", "MFT Entry Changed"),
]
ROOT_RECORD = 5
RECORD_MASK = 0x0000FFFFFFFFFFFF
# ------------------------------------------------------------ end fixed values


def _macb(si: dict[str, Column], fn: dict[str, Column]) -> list[tuple]:
    """Up to eight (time, description, source) candidates."""
    return [(si[k], d, "si") for k, d in TIME_KINDS] + [(fn[k], f"{d} ($FN)", "fn") for k, d in TIME_KINDS]


def _macb_emit(times: list[tuple], prefix: Column, path: Column, source: tuple[str, str], attrs: dict) -> Emit:
    by_name = word() == "fn"
    return Emit(
        fan_out=True,
        event_type=F.when(by_name, F.lit("file_timeline_fn")).otherwise(F.lit("file_timeline")),
        data_type=F.when(by_name, F.lit(FN_TYPE)).otherwise(F.lit(SI_TYPE)),
        message=F.concat(prefix, F.when(by_name, F.lit(" ($FN): ")).otherwise(F.lit(": ")), path),
        times=times,
        source=(
            source[0],
            F.concat(F.lit(source[1]), F.when(by_name, F.lit("$FILE_NAME")).otherwise(F.lit("$STANDARD_INFORMATION"))),
        ),
        attrs=attrs,
        event_attrs={"timestompNote": F.when(by_name, F.lit(TIMESTOMP_NOTE))},
    )


@builder("section.file")
def file_records(df: DataFrame) -> DataFrame:
    """Collected-file records: four content times and four name times each."""
    path = F.when(rec("fullPath") != "", rec("fullPath")).otherwise(rec("path"))
    kind = F.when(rec("metaType") != "", rec("metaType")).otherwise(F.lit("File"))
    hashed = (rec("md5hash") != "") | (rec("sha1hash") != "") | (rec("sha256hash") != "")
    prefix = F.when(kind == "Dir", F.lit("Directory")).when(hashed, F.lit("File (hashed)")).otherwise(F.lit("File"))
    si = {k: epoch_ms(rec("date" + k.capitalize())) for k, _ in TIME_KINDS}
    fn = {k: epoch_ms(rec("fn_date" + k.capitalize())) for k, _ in TIME_KINDS}
    pe = parse_map(F.col("rec")["peHeaderInfo"])
    attrs = {
        "file_path": path, "file_name": "fileName", "file_size": "fileSize", "meta_type": kind,
        "file_content_status": "fileContentStatus", "md5": "md5hash", "sha1": "sha1hash", "sha256": "sha256hash",
        "imphash": "imphash", "signature": "Signature", "score": "score", "score_description": "scoreDescription",
        "user_sid": "userSID", "is_deleted": "isDeleted", "is_name_del": "isNameDel",
        "file_mime_type": "fileMimeType", "volume_offset": "volumeOffset", "meta_data_addr": "metaDataAddr",
        "pe_company": pe["companyName"], "pe_product": pe["productName"], "pe_description": pe["fileDescription"],
        "pe_original_filename": pe["originalFilename"], "pe_imphash": pe["imphash"],
    }
    return build(df, with_analysis(_macb_emit(_macb(si, fn), prefix, path, ("CT-MFT", "MFT - "), attrs)))


@builder("live.filesystem")
def file_listing(df: DataFrame) -> DataFrame:
    """Directory-listing rows: modified, accessed and created."""
    directory = F.lower(rec("is_directory")) == "true"
    return build(df, Emit(
        fan_out=True,
        event_type="file_timeline", data_type="fs:stat",
        message=F.concat(F.when(directory, F.lit("Directory: ")).otherwise(F.lit("File: ")), rec("path")),
        times=[
            (event_time(rec("modified")), "File Modified"), (event_time(rec("accessed")), "File Accessed"),
            (event_time(rec("created")), "File Created"),
        ],
        source=("Collector-FileSystem", "Windows Collector - Filesystem Enumeration"),
        attrs={
            "file_path": "path", "file_name": "name", "file_size": "size",
            "meta_type": F.when(directory, F.lit("Dir")).otherwise(F.lit("File")), "file_extension": "extension",
        },
    ))


def merge_extension_records(entries: DataFrame) -> DataFrame:
    """One row per base MFT record: name fields from the record that has them,
    else from its first extension; content times from the base record.

    `entries`: volume keys, record_num, base_ref, parent_ref, flags, file_name,
    file_size, si_*, fn_*, has_si, has_fn. Aggregated by base number, so a
    record's pieces meet in one map-side-combined group.
    """
    own = F.coalesce(F.col("base_ref"), F.lit(0)) == 0
    # The base record outranks extensions; among extensions the first one wins.
    order = F.struct((~own).cast("int"), F.col("record_num"))
    names = F.struct("file_name", "parent_ref", "fn_modified", "fn_created", "fn_accessed", "fn_changed")
    times = F.struct("si_modified", "si_created", "si_accessed", "si_changed", "flags")
    merged = (
        entries.where(own | F.col("has_fn"))
        .groupBy("upload_id", "volume", F.when(own, F.col("record_num")).otherwise(F.col("base_ref")).alias("record_num"))
        .agg(
            F.min_by(names, F.when(F.col("has_fn"), order)).alias("n"),
            F.min_by(times, F.when(F.col("has_si"), order)).alias("t"),
            F.min_by("flags", order).alias("flags0"),
            F.min_by("file_size", order).alias("file_size"),
            F.bool_or("has_fn").alias("has_fn"),
            F.bool_or("has_si").alias("has_si"),
        )
    )
    return merged.select(
        "upload_id", "volume", "record_num", "n.file_name", "n.parent_ref",
        F.coalesce("t.flags", "flags0").alias("flags"), "file_size", "has_fn", "has_si",
        "n.fn_modified", "n.fn_created", "n.fn_accessed", "n.fn_changed",
        "t.si_modified", "t.si_created", "t.si_accessed", "t.si_changed",
    )


def resolve_paths(
    nodes: DataFrame, keys: list[str], node: str, parent: str, name: str, root: int = ROOT_RECORD, sep: str = "\\",
    max_rounds: int = 40,
) -> DataFrame:
    """Path of every node whose parent chain reaches `root`; broken or cyclic
    chains are dropped. Returns keys, node, `path` (joined names, root left out).

    Pointer doubling: in each round a node takes over its pointer's pointer and
    path, so a chain of depth d needs log2(d) equi joins instead of d. A node
    whose pointer is missing drops out of the join; once a round completes no
    further node, only cycles are left. The pointed-at side has one row per
    node, so a directory with very many children is a one-sided skew that the
    adaptive skew join splits.
    """
    name_of, up_of = F.col(name), F.col(parent).cast("long")
    state = nodes.where(name_of != "").select(
        *keys, F.col(node).cast("long").alias("node"), F.when(up_of != root, up_of).alias("up"), name_of.alias("path"),
    )
    state = cut_lineage(state)
    done = -1
    for _ in range(max_rounds):
        count = state.agg(F.count_if(F.col("up").isNull()).alias("done"), F.count("up").alias("open")).first()
        if count["open"] == 0 or count["done"] == done:
            break
        done = count["done"]
        above = state.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        moved = state.where(F.col("up").isNotNull()).join(above, [*keys, "up"]).where(
            F.coalesce(F.col("next") != F.col("node"), F.lit(True))
        )
        state = cut_lineage(
            state.where(F.col("up").isNull()).unionByName(
                moved.select(*keys, "node", F.col("next").alias("up"), F.concat("above", F.lit(sep), "path").alias("path"))
            )
        )
    return state.where(F.col("up").isNull()).select(*keys, "node", "path")


def mft_events(entries: DataFrame, captures: DataFrame, drive: str = "C") -> DataFrame:
    """Decoded MFT records -> file timeline with resolved paths.

    `captures` gives site_id and host_name per upload_id.
    """
    base = merge_extension_records(entries).withColumn(
        "parent_num", F.col("parent_ref").bitwiseAND(F.lit(RECORD_MASK))
    )
    paths = resolve_paths(base, ["upload_id", "volume"], "record_num", "parent_num", "file_name")
    full = F.concat(F.lit(f"{drive}:\\"), F.col("path"))
    joined = (
        base.join(paths.withColumnRenamed("node", "record_num"), ["upload_id", "volume", "record_num"])
        .join(captures.select("upload_id", "site_id", "host_name"), "upload_id")
        .withColumn("full_path", full)
        .withColumn("seq", F.col("record_num"))
        .withColumn("rec", F.expr("cast(map() as map<string,string>)"))
    )
    directory = F.col("flags").bitwiseAND(F.lit(2)) != 0

    def valid(flag: str, name: str) -> Column:
        return F.when(F.col(flag) & (F.year(name) >= 1980), F.date_trunc("second", name))

    si = {k: valid("has_si", f"si_{k}") for k, _ in TIME_KINDS}
    fn = {k: valid("has_fn", f"fn_{k}") for k, _ in TIME_KINDS}
    prefix = F.when(directory, F.lit("Directory")).otherwise(F.lit("File"))
    attrs = {
        "file_path": parent_dir(F.col("full_path")), "file_name": base_name(F.col("full_path")),
        "file_size": F.col("file_size"), "full_path": F.col("full_path"),
        "meta_type": F.when(directory, F.lit("Dir")).otherwise(F.lit("File")),
    }
    return build(joined, _macb_emit(_macb(si, fn), prefix, F.col("full_path"), ("Collector-MFT", "MFT - "), attrs))


def listing_where_no_mft(listing_events: DataFrame, mft: DataFrame) -> DataFrame:
    """Listing events only of the captures that have no MFT events."""
    have = mft.where(F.col("event_type").isin("file_timeline", "file_timeline_fn")).select("upload_id").distinct()
    return listing_events.join(have, "upload_id", "left_anti").select(*listing_events.columns)


def timestomp_candidates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Files (`keys` name the capture and the path) whose name record was created
    after their content record: the two
    creation times meet in one aggregation per file, without a self-join."""
    created = events.where(F.col("timestamp_desc").isin("File Created", "File Created ($FN)"))
    si = F.max(F.when(F.col("timestamp_desc") == "File Created", F.col("datetime"))).alias("si_created")
    fn = F.max(F.when(F.col("timestamp_desc") == "File Created ($FN)", F.col("datetime"))).alias("fn_created")
    return created.groupBy(*keys).agg(si, fn).where(F.col("fn_created") > F.col("si_created"))


@builder("prefetch")
def prefetch(df: DataFrame) -> DataFrame:
    """Prefetch rows: one event per recorded run time."""
    runs = F.from_json(rec("last_run_times"), "array<string>")
    df = df.withColumn("_run", F.explode(runs)).withColumn("_ts", event_time(F.col("_run")))
    count = whole_number(rec("run_count"))
    return build(df, Emit(
        where=F.year("_ts").between(1970, 2100),
        event_type="prefetch_execution", data_type="windows:prefetch:execution",
        message=F.concat(
            say("Program executed: {executable}"),
            F.when(count > 0, say(" (run count: {run_count})")).otherwise(F.lit("")),
        ),
        times=[(F.col("_ts"), "Prefetch Execution Time")],
        source=("CT-Prefetch", "Prefetch"),
        attrs={
            "executable": "executable", "prefetch_file": "file_name", "prefetch_path": "file_path",
            "run_count": "run_count", "hash": "hash",
        },
    ))


@builder("recycle_bin")
def recycle_bin(df: DataFrame) -> DataFrame:
    size = F.coalesce(whole_number(rec("file_size")), F.lit(0))
    return build(df, Emit(
        event_type="file_deleted", data_type="windows:shell_items:recycle_bin",
        message=say("Deleted: {path} ({k} KB)", k=one_decimal(size.cast("double") / 1024)),
        times=[(filetime(rec("deletion_time")), "File Deletion Time")],
        source=("CT-RecycleBin", "Recycle Bin"),
        attrs={"file_path": "path", "file_size": size, "file_name": "file_name"},
    ))


@builder("shortcut")
def shortcuts(df: DataFrame) -> DataFrame:
    target = F.when(rec("local_base_path") != "", rec("local_base_path")).otherwise(rec("local_base_path_unicode"))
    shown = F.substring_index(F.when(target != "", target).otherwise(rec("file_name")), "\\", -1)

    def stamp(name: str) -> Column:
        ts = event_time(rec(name))
        return F.when((F.year(ts) > 1970) & (F.year(ts) < 2100), ts)

    return build(df, Emit(
        fan_out=True,
        event_type="lnk_target", data_type="windows:lnk:link",
        message=F.concat(F.lit("Shortcut target "), word(), F.lit(": "), shown),
        times=[
            (stamp("creation_time"), "LNK Target Created", "created"),
            (stamp("write_time"), "LNK Target Modified", "modified"),
            (stamp("access_time"), "LNK Target Accessed", "accessed"),
        ],
        source=("CT-LNK", "Windows Shortcut"),
        attrs={"lnk_file": "file_name", "lnk_path": "file_path", "link_target": target},
    ))
