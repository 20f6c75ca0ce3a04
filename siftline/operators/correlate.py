"""Cross-source correlation: mail, clicks, sign-ins, hashes, identities.

Each link reports a row once with its best partner instead of every pair, so
the output stays linear in the input even when one key dominates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def clicks_with_mail(mails: DataFrame, clicks: DataFrame, key: str = "message_id") -> DataFrame:
    """Clicks with the mail of the same message id. Copies of a mail are folded
    to the first one (by datetime, id) and their number, so every click joins
    exactly one row."""
    first = F.min_by(F.struct("id", "datetime", "sender", "subject"), F.struct("datetime", "id")).alias("m")
    folded = mails.where(F.col(key).isNotNull()).groupBy(key).agg(first, F.count(F.lit(1)).alias("mail_count"))
    return clicks.join(folded, key).select(
        key, F.col("id").alias("click_id"), F.col("datetime").alias("click_time"), "url",
        F.col("m.id").alias("mail_id"), F.col("m.datetime").alias("mail_time"), "m.sender", "m.subject", "mail_count",
    )


def latest_before(
    left: DataFrame, right: DataFrame, keys: list[str], within: int = HOUR, chunk: int = 60_000_000
) -> DataFrame:
    """Every row of `left` (keys, id, micros) with the latest `right` (keys,
    micros) row at or before it, at most `within` microseconds earlier.

    Distinct right times are taken first. The running maximum is then carried in
    two levels: over the rows of one chunk of time, and over one summary row per
    chunk, so a key with most of the data is spread over its chunks.
    """
    times = right.select(*keys, F.col("micros")).distinct()
    both = left.select(*keys, "micros", F.lit(1).alias("side"), "id").unionByName(
        times.select(*keys, "micros", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"))
    ).withColumn("_chunk", F.call_function("div", F.col("micros"), F.lit(chunk).cast("long")))
    ends = times.groupBy(*keys, F.call_function("div", F.col("micros"), F.lit(chunk).cast("long")).alias("_chunk")).agg(
        F.max("micros").alias("_end")
    )
    wanted = both.where(F.col("side") == 1).select(*keys, "_chunk").distinct()
    summary = wanted.join(ends, [*keys, "_chunk"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_carry", F.max("_end").over(before)).drop("_end")
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy("micros", "side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = both.withColumn("_seen", F.max(F.when(F.col("side") == 0, F.col("micros"))).over(inside))
    out = seen.where(F.col("side") == 1).join(carried, [*keys, "_chunk"])
    latest = F.greatest("_seen", "_carry")
    return out.select(*keys, "id", "micros", latest.alias("match_micros")).where(
        F.col("match_micros") >= F.col("micros") - within
    )


def signins_after_click(clicks: DataFrame, signins: DataFrame, within: int = HOUR) -> DataFrame:
    """Sign-ins of a user within an hour after a click, each with its latest click."""
    return latest_before(signins, clicks, ["user"], within)


def clicks_before_signin(clicks: DataFrame, signins: DataFrame, within: int = HOUR) -> DataFrame:
    """The other direction: clicks followed by a sign-in within the hour, each
    with the earliest such sign-in (time runs backwards for this one)."""
    mirror = latest_before(
        clicks.withColumn("micros", -F.col("micros")), signins.withColumn("micros", -F.col("micros")), ["user"], within
    )
    return mirror.select("user", "id", (-F.col("micros")).alias("micros"), (-F.col("match_micros")).alias("match_micros"))


def files_with_attachment(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Endpoint files whose hash was a mail attachment: attachments are folded
    to one row per hash (first mail and count) before the join."""
    folded = attachments.where(F.col("sha256") != "").groupBy(F.lower("sha256").alias("hash")).agg(
        F.min("mail_id").alias("first_mail"), F.count_distinct("mail_id").alias("mail_count")
    )
    return files.withColumn("hash", F.lower("sha256")).join(folded, "hash").select(
        "hash", F.col("id").alias("file_id"), "first_mail", "mail_count"
    )


def identity_values(df: DataFrame, fields: list[Column], names: list[str]) -> DataFrame:
    """(id, field, value) for every identity field that is filled."""
    items = F.array(*[F.struct(F.lit(n).alias("field"), F.lower(c).alias("value")) for n, c in zip(names, fields)])
    kept = F.filter(items, lambda i: i["value"].isNotNull() & (i["value"] != "") & (i["value"] != "-"))
    return df.select("id", "event_type", F.inline(kept))


def identity_activity(values: DataFrame) -> DataFrame:
    """Per identity: in how many events and through which fields it appears.
    `identity_values` gives one row per event and field, so rows are counted."""
    per_field = values.groupBy("value", "field").agg(F.count(F.lit(1)).alias("n"))
    return per_field.groupBy("value").agg(
        F.sum("n").alias("mentions"), F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields")
    )


def events_of_identities(df: DataFrame, values: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events that name any wanted identity (`value`) in any field."""
    ids = values.join(wanted.select(F.lower("value").alias("value")).distinct(), "value", "left_semi").select("id").distinct()
    return df.join(ids, "id", "left_semi")
