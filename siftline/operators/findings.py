"""Analyst findings: an append-only log laid over the events.

Marking events never rewrites the event table; the current finding of an event
is its latest log entry, picked by a map-side-combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_COLUMNS = ["site_id", "event_id", "seq", "finding", "finding_note"]


def mark(ids: DataFrame, site: str, finding: str | None, note: str | None, seq: int) -> DataFrame:
    """Log entries that set (or, with None, clear) the finding of the events in
    `ids` (column `event_id`)."""
    return ids.select(
        F.lit(site).alias("site_id"), "event_id", F.lit(seq).cast("long").alias("seq"),
        F.lit(finding).cast("string").alias("finding"), F.lit(note).cast("string").alias("finding_note"),
    )


def current_findings(log: DataFrame) -> DataFrame:
    """Latest entry per event; cleared findings are left out."""
    last = F.max_by(F.struct("finding", "finding_note"), "seq").alias("last")
    return (
        log.groupBy("site_id", "event_id").agg(last)
        .select("site_id", "event_id", "last.finding", "last.finding_note")
        .where(F.col("finding").isNotNull())
    )


def with_findings(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events with their current finding and note (columns of the same name)."""
    current = current_findings(log).withColumnRenamed("event_id", "id")
    base = events.drop("finding", "finding_note")
    return base.join(current, ["site_id", "id"], "left").select(*base.columns, "finding", "finding_note")


def delete_captures(df: DataFrame, doomed: DataFrame, key: str = "upload_id") -> DataFrame:
    """Rows of the captures (or sites) that are not in `doomed`."""
    return df.join(doomed.select(key).distinct(), key, "left_anti").select(*df.columns)
