"""Kept summaries: per capture, states that can be merged, so that a report reads rows
per capture and not events.

A state is written for each capture (site_id, upload_id) and replaced when its capture
has changed; `refresh` tells that by the files of the capture's partition alone. Reads
fold the states of a site, or of one capture: counts are added, first and last times
compared, sets of distinct values united, so a fold equals the summary of all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.times import iso_ms
from siftline.functions.values import any_of
from siftline.operators.filters import NOTABLE, STOP_WORDS, attr, search, split_words
from siftline.operators.summaries import LOGON_EVENTS, REMOTE_TOOLS, remote_access

CAPTURE = ["site_id", "upload_id"]
SEPARATORS = r"[^\p{L}\p{N}_]+"
#: So many captures are named as literals; more are joined.
NAMED = 1000


def type_states(events: DataFrame) -> DataFrame:
    """Events, notable and suspicious ones per type."""
    return events.groupBy(*CAPTURE, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ct_significance") == NOTABLE).alias("notable"), F.count_if("is_suspicious").alias("suspicious"))


def logon_states(events: DataFrame) -> DataFrame:
    """What `summaries.logon_summary` folds, per user."""
    def usable(name: str, *skip: str) -> Column:
        return F.when(~attr(events, name).isin("", *skip), attr(events, name))

    event_id = attr(events, "event_identifier")
    user = F.coalesce(attr(events, "TargetUserName"), attr(events, "User"), F.lit("unknown"))
    return events.where(F.col("event_type").isin(LOGON_EVENTS)).groupBy(*CAPTURE, user.alias("username")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(event_id == "4624").alias("success"), F.count_if(event_id == "4625").alias("fail"),
        F.collect_set(usable("IpAddress", "-")).alias("ips"), F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        F.collect_set(usable("AuthenticationPackageName")).alias("packages"), F.collect_set(usable("LogonType")).alias("types"),
        F.max(usable("TargetDomainName", "-")).alias("domain"))


def remote_states(events: DataFrame) -> DataFrame:
    """Remote-access tools of a capture."""
    return remote_access(events, CAPTURE).select(*CAPTURE, "tool_name", "event_count", "event_types", "first_seen", "last_seen")


def gram_states(events: DataFrame) -> DataFrame:
    """Three-letter pieces of all words that the events of a capture hold: words are
    made distinct first, so the pieces come from a capture's vocabulary, not its text."""
    texts = F.concat(F.array(F.coalesce("message", F.lit(""))), F.map_keys("attrs"), F.map_values("attrs"))
    words = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.split(F.lower(F.coalesce(t, F.lit(""))), SEPARATORS))))
    distinct = events.select(*CAPTURE, F.explode(words).alias("word")).where(F.length("word") >= 3).distinct()
    pieces = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3)))
    return distinct.select(*CAPTURE, F.explode(pieces).alias("gram")).distinct()


STATES: dict[str, Callable[[DataFrame], DataFrame]] = {"types": type_states, "logons": logon_states, "remote": remote_states, "grams": gram_states}


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stamps(events: DataFrame) -> DataFrame:
    """(site_id, upload_id, stamp) by the files of each capture; no column is read."""
    meta = events.select(*CAPTURE, F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("at"))
    files = meta.groupBy(*CAPTURE, "name").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    return files.groupBy(*CAPTURE).agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(
        F.concat_ws(",", "name", F.col("at").cast("string"), F.col("n").cast("string"))))), 256).alias("stamp"))


def refresh(spark: SparkSession, table: str, store: str) -> list[tuple[str, str]]:
    """Renew the states of captures that are new or changed since; returns these.
    States are written before the stamps, so a failure repeats the work."""
    events = spark.read.parquet(table)
    now, known = stamps(events), _table(spark, f"{store}/stamps")
    fresh = now if known is None else now.join(known, [*CAPTURE, "stamp"], "left_anti")
    rows = fresh.collect()  # a row per changed capture
    if not rows:
        return []
    changed = [(r["site_id"], r["upload_id"]) for r in rows]
    wanted = spark.createDataFrame(changed, "site_id string, upload_id string")
    # The names as literals too, so that only these partitions are read.
    some = events.where(F.col("upload_id").isin([u for _, u in changed]) & F.col("site_id").isin(sorted({s for s, _ in changed})))
    some = some.join(F.broadcast(wanted), CAPTURE, "left_semi")
    for name, state in STATES.items():
        # A capture without such events keeps no row; its old ones go first.
        made = state(some).withColumn("kept", F.lit(True))
        empty = wanted.select(*CAPTURE, F.lit(False).alias("kept"))
        _replace(made.unionByName(empty, allowMissingColumns=True), f"{store}/{name}")
    _replace(spark.createDataFrame([tuple(r) for r in rows], fresh.schema), f"{store}/stamps")
    return sorted(changed)


def _replace(df: DataFrame, path: str) -> None:
    df.repartition(*CAPTURE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CAPTURE).parquet(path)


def states(spark: SparkSession, store: str, name: str, site: str | None = None, upload: str | None = None) -> DataFrame:
    """A kept table, of one site or capture where named."""
    df = spark.read.parquet(f"{store}/{name}").where("kept").drop("kept")
    for column, value in (("site_id", site), ("upload_id", upload)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def _united(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))


def kept_types(found: DataFrame) -> DataFrame:
    return found.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("notable").alias("notable"), F.sum("suspicious").alias("suspicious"))


def kept_logons(found: DataFrame) -> DataFrame:
    """`summaries.logon_summary` of the states' events."""
    return found.groupBy("username").agg(
        F.sum("n").alias("total_events"), F.sum("success").alias("success_count"), F.sum("fail").alias("fail_count"),
        F.size(_united("ips")).cast("long").alias("unique_ips"), iso_ms(F.min("first")).alias("first_seen"), iso_ms(F.max("last")).alias("last_seen"),
        F.array_join(_united("packages"), ", ").alias("auth_packages"), F.array_join(_united("types"), ", ").alias("logon_types"), F.max("domain").alias("domain"))


def kept_remote_access(found: DataFrame) -> DataFrame:
    """`summaries.remote_access` of the states' events."""
    facts = {n: (c, ts) for n, c, ts in REMOTE_TOOLS}
    category = F.create_map(*[F.lit(x) for n, (c, _) in facts.items() for x in (n, c)])
    return found.groupBy("tool_name").agg(
        F.sum("event_count").alias("event_count"), _united("event_types").alias("event_types"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen")).withColumn("category", category[F.col("tool_name")])


def cached_remote_access(spark: SparkSession, table: str, store: str, site: str | None = None, upload: str | None = None) -> DataFrame:
    """The kept result; states that are missing or old are made first."""
    refresh(spark, table, store)
    return kept_remote_access(states(spark, store, "remote", site, upload))


def grams_of(query: str) -> list[str]:
    """Pieces that any record a search finds must hold in its capture. All words of
    the query are in a found record, whole or as parts of longer ones, whichever of the
    search's tests is met; stop words are only when the text itself is."""
    words = [w for w in split_words(query) if w not in STOP_WORDS]
    return sorted({w[i:i + 3] for w in words for i in range(len(w) - 2)})


def search_events(spark: SparkSession, table: str, store: str, query: str, site: str | None = None) -> DataFrame:
    """Free search over the stored events, reading only captures that may hold what
    is asked; the exact test follows, so the rows are those of `filters.search`. States
    that are missing or old are made first."""
    refresh(spark, table, store)
    events, wanted = spark.read.parquet(table), grams_of(query)
    if site is not None:
        events = events.where(F.col("site_id") == site)
    if wanted:
        held = states(spark, store, "grams", site).where(F.col("gram").isin(wanted)).groupBy(*CAPTURE).agg(F.count(F.lit(1)).alias("n"))
        captures = held.where(F.col("n") == len(wanted)).select(*CAPTURE)
        named = captures.limit(NAMED + 1).collect()
        if len(named) > NAMED:
            events = events.join(captures, CAPTURE, "left_semi")
        else:
            events = events.where(any_of([(F.col("site_id") == s) & (F.col("upload_id") == u) for s, u in named]) if named else F.lit(False))
    return events.where(search(events, query))
