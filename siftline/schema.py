"""The event frame every builder produces and every query reads.

`attrs` holds the open attribute bag as text, one entry per key of the original
record. Attributes that filters hit most are promoted to columns when the table
is written, so that Parquet statistics can prune on them.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["upload_id", "site_id", "host_name", "seq"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("upload_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("timestamp_desc", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("source_short", T.StringType()),
        T.StructField("source_long", T.StringType()),
        T.StructField("ct_significance", T.StringType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        # Digest of the whole text of which the message shows a part, NULL where it
        # shows all; events are told apart by it.
        T.StructField("content", T.StringType()),
    ]
)

EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]

DEDUPE_KEY = ["upload_id", "datetime", "timestamp_desc", "message", "event_type", "content"]

# Columns of the stored table that a field filter addresses directly; any other
# name is looked up in the attribute bag.
TOP_LEVEL = [
    "event_type", "message", "host_name", "source_short", "data_type",
    "timestamp_desc", "ct_significance", "finding", "finding_note", "is_suspicious",
]

PROMOTED = [
    "event_identifier", "channel", "file_path", "file_name",
    "TargetUserName", "IpAddress", "record_number",
]

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("collector_version", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("os_version", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("collection_timestamp", T.StringType()),
        T.StructField("collection_duration_seconds", T.DoubleType()),
    ]
)
