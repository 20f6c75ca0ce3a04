"""Timestamp conversions (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.values import real_number, whole_number

# Epoch offsets of the source formats.
FILETIME_UNIX_TICKS = 116444736000000000
WEBKIT_UNIX_MICROS = 11644473600000000
MAC_UNIX_SECONDS = 978307200
OLE_UNIX_DAYS = 25569
FILETIME_THRESHOLD = 100000000000

_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+|(Z|[+-]\d{2}:?\d{2})?$)"
_FRACTION = r"^.{19}\.(\d{1,3})"
_OFFSET = r"([+-])(\d{2}):?(\d{2})$"

INSTALL_DATE_FORMATS = [
    "yyyyMMdd", "M/d/yyyy H:m:s", "M/d/yyyy h:m:s a", "yyyy-MM-dd H:m:s", "M/d/yyyy", "yyyy-MM-dd",
]
INGEST_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss",
]


def _whole_div(col: Column, by: int) -> Column:
    return F.call_function("div", col, F.lit(by).cast("long"))


def normalize_ts(col: Column, apply_offset: bool = False) -> Column:
    """Text in any accepted shape -> `yyyy-MM-ddTHH:mm:ss.SSSZ`, else NULL.

    Fractions are cut, not rounded, to milliseconds. The zone offset is dropped
    by default, as the reference semantics demand; `apply_offset` shifts to UTC.
    """
    text = F.trim(col)
    fraction = F.rpad(F.regexp_extract(text, _FRACTION, 1), 3, "0")
    plain = F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
        F.lit("."), fraction, F.lit("Z"),
    )
    stamp = F.when(text.rlike(_STAMP), plain)
    if not apply_offset:
        return stamp
    minutes = (
        F.when(F.regexp_extract(text, _OFFSET, 1) == "-", 1).otherwise(-1)
        * (
            F.coalesce(F.regexp_extract(text, _OFFSET, 2).try_cast("int"), F.lit(0)) * 60
            + F.coalesce(F.regexp_extract(text, _OFFSET, 3).try_cast("int"), F.lit(0))
        )
    )
    moved = F.timestamp_millis(F.unix_millis(F.try_to_timestamp(stamp)) + minutes * 60000)
    return iso_ms(moved)


def iso_ms(ts: Column) -> Column:
    """Timestamp -> ISO text with milliseconds (cut) and `Z`."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_time(col: Column, apply_offset: bool = False) -> Column:
    """Text -> timestamp under the rules of `normalize_ts`."""
    return F.try_to_timestamp(normalize_ts(col, apply_offset))


def epoch_ms(col: Column) -> Column:
    """Epoch milliseconds as number or text; 0 and blank -> NULL; other text is
    read as a timestamp."""
    number = whole_number(col)
    return (
        F.when(number.isNotNull() & (number != 0), F.timestamp_millis(number))
        .when(number.isNull(), event_time(col.cast("string")))
    )


def epoch_seconds(col: Column) -> Column:
    number = whole_number(col)
    return F.when(number > 0, F.timestamp_seconds(number))


def filetime(col: Column) -> Column:
    """100 ns ticks since 1601; before 1970 -> NULL."""
    ticks = whole_number(col)
    return F.when(
        ticks >= FILETIME_UNIX_TICKS,
        F.timestamp_micros(_whole_div(ticks - F.lit(FILETIME_UNIX_TICKS), 10)),
    )


def webkit_micros(col: Column) -> Column:
    """Microseconds since 1601; not positive or before 1970 -> NULL."""
    micros = whole_number(col)
    return F.when(micros >= WEBKIT_UNIX_MICROS, F.timestamp_micros(micros - F.lit(WEBKIT_UNIX_MICROS)))


def unix_micros(col: Column) -> Column:
    """Microseconds since 1970 as number or text (browser and journal records)."""
    micros = whole_number(col)
    return F.when(micros > 0, F.timestamp_micros(micros))


def mac_absolute(col: Column) -> Column:
    """Seconds since 2001 as a double; 0 and NaN -> NULL."""
    seconds = real_number(col)
    return F.when(
        ~F.isnan(seconds) & (seconds != 0),
        F.timestamp_micros(F.round((seconds + F.lit(MAC_UNIX_SECONDS)) * 1000000.0).cast("long")),
    )


def ole_date(col: Column) -> Column:
    """Days since 1899-12-30 as a double; outside 1970-2100 -> NULL."""
    days = real_number(col)
    ts = F.timestamp_micros(F.round((days - F.lit(OLE_UNIX_DAYS)) * 86400000000.0).cast("long"))
    return F.when(~F.isnan(days) & (days != 0) & (F.abs(days) < 1.0e6) & F.year(ts).between(1970, 2100), ts)


def seconds_or_filetime(col: Column) -> Column:
    """Large magnitudes are ticks since 1601, small ones Unix seconds."""
    number = real_number(col).try_cast("long")
    return F.when(number > FILETIME_THRESHOLD, filetime(number)).otherwise(epoch_seconds(number))


def first_format(col: Column, formats: list[str]) -> Column:
    """First format that parses wins; none -> NULL."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def install_date(col: Column) -> Column:
    """Install date text of the software report: ISO first, then six formats."""
    text = F.trim(col)
    iso = F.when(text.contains("T") | text.endswith("Z"), F.try_to_timestamp(text))
    return F.coalesce(iso, first_format(text, INSTALL_DATE_FORMATS))


def login_list_date(col: Column) -> Column:
    """`Thu Apr 20 18:00:01 2026` -> timestamp (weekday is not checked)."""
    squeezed = F.regexp_replace(F.trim(col), r"\s+", " ")
    return F.try_to_timestamp(F.regexp_replace(squeezed, r"^\S+ ", ""), F.lit("MMM d HH:mm:ss yyyy"))


def history_date(col: Column) -> Column:
    """`5/8/25, 4:14 AM` with two- or four-digit year, AM/PM optional."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{2,4}),\s*(\d{1,2}):(\d{2})\s*(AM|PM)?"

    def part(n: int) -> Column:
        return F.regexp_extract(col, pattern, n).try_cast("int")

    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    half = F.regexp_extract(col, pattern, 6)
    hour = (
        F.when((half == "PM") & (part(4) < 12), part(4) + 12)
        .when((half == "AM") & (part(4) == 12), F.lit(0))
        .otherwise(part(4))
    )
    return F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d %02d:%02d", year, part(1), part(2), hour, part(5)),
        F.lit("yyyy-MM-dd HH:mm"),
    )
