"""String, path and URL helpers (Column in, Column out)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_ROT = _LOWER[13:] + _LOWER[:13] + _UPPER[13:] + _UPPER[:13]

SECRET_WORDS = "password|secret|token|key"


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def strip_control_escapes(col: Column) -> Column:
    """Remove the JSON escapes of the control characters U+0000 to U+0008."""
    return F.regexp_replace(col, r"\\u000[0-8]", "")


def ellipsis(col: Column, limit: int) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def one_line(col: Column, limit: int = 200) -> Column:
    """First line of the trimmed text, with an ellipsis beyond `limit`."""
    trimmed = F.regexp_replace(col, r"^\s+|\s+$", "")
    return ellipsis(F.substring_index(trimmed, "\n", 1), limit)


def one_decimal(col: Column) -> Column:
    """One decimal, ties to even (Java's own `%.1f` rounds ties up)."""
    return F.format_string("%.1f", F.bround(col, 1))


def human_bytes(col: Column) -> Column:
    def scaled(shift: int, unit: str) -> Column:
        return F.concat(one_decimal(col.cast("double") / float(1 << shift)), F.lit(unit))

    return (
        F.when(col >= 1 << 30, scaled(30, "GB"))
        .when(col >= 1 << 20, scaled(20, "MB"))
        .when(col >= 1 << 10, scaled(10, "KB"))
        .otherwise(F.concat(col.cast("string"), F.lit("B")))
    )


def human_cpu(cycles: Column) -> Column:
    """Cycle time (100 ns) -> `1.2h`, `3.4m` or `5s`."""
    seconds = cycles.cast("double") / 1.0e7
    return (
        F.when(seconds > 3600, F.concat(one_decimal(seconds / 3600), F.lit("h")))
        .when(seconds > 60, F.concat(one_decimal(seconds / 60), F.lit("m")))
        .otherwise(F.format_string("%.0fs", F.bround(seconds, 0)))
    )


def human_duration(seconds: Column, minute_decimals: int = 1) -> Column:
    """Whole seconds -> hours / minutes / seconds text."""
    minutes = F.format_string(f"%.{minute_decimals}fm", F.bround(seconds.cast("double") / 60, minute_decimals))
    return (
        F.when(seconds >= 3600, F.concat(one_decimal(seconds.cast("double") / 3600), F.lit("h")))
        .when(seconds >= 60, minutes)
        .otherwise(F.format_string("%ds", seconds.cast("long")))
    )


def split_host_port(col: Column, dots: bool = False) -> tuple[Column, Column]:
    """`ip:port` and `[v6]:port`; with `dots` also the `ip.port` dialect. A colon
    before a port wins where what stands before it is no IPv6 address."""
    text = F.trim(col)
    bracket = r"^\[([^\]]*)\][:.]?(.*)$"
    colon = r"^(.+):([^:]*)$"
    dot = r"^(.+)\.([^.]*)$"
    one_colon = r"^([^:]+):(\d+|\*)$"

    def pick(n: int, whole: Column) -> Column:
        chain = F.when(text.rlike(bracket), F.regexp_extract(text, bracket, n))
        if dots:
            chain = F.when(text == "*", F.lit("")).when(text.rlike(bracket), F.regexp_extract(text, bracket, n))
            chain = chain.when(text.rlike(one_colon), F.regexp_extract(text, one_colon, n))
            chain = chain.when(text.rlike(dot), F.regexp_extract(text, dot, n))
        return chain.when(text.rlike(colon), F.regexp_extract(text, colon, n)).otherwise(whole)

    host = pick(1, text)
    if dots:
        # Only the dotted dialect writes "any address" as an empty host.
        host = F.when((host == "*") & text.rlike(dot), F.lit("")).otherwise(host)
    return host, pick(2, F.lit(""))


def split_domain_user(col: Column) -> tuple[Column, Column]:
    """`DOMAIN\\user` -> (domain, user); no backslash -> ('', text)."""
    has = col.contains("\\")
    user = F.substring_index(col, "\\", -1)
    domain = F.when(has, F.regexp_replace(col, r"\\[^\\]*$", "")).otherwise(F.lit(""))
    return domain, user


def forward_slashes(col: Column) -> Column:
    return F.translate(col, "\\", "/")


def drive_path(col: Column) -> Column:
    """`C:\\Dir\\f` -> `/c/Dir/f`."""
    path = forward_slashes(col)
    return F.when(
        path.rlike("^.:"), F.concat(F.lit("/"), F.lower(F.substring(path, 1, 1)), F.substring(path, 3, 1 << 30))
    ).otherwise(path)


def parent_dir(col: Column) -> Column:
    """Lower-case parent directory with trailing slash, `/` when there is none."""
    path = drive_path(col)
    return F.when(
        path.contains("/"), F.lower(F.regexp_replace(path, r"[^/]*$", ""))
    ).otherwise(F.lit("/"))


def base_name(col: Column) -> Column:
    return F.substring_index(forward_slashes(col), "/", -1)


def extension(col: Column) -> Column:
    """Lower-case text after the last dot, '' when there is none."""
    return F.when(F.contains(col, F.lit(".")), F.lower(F.substring_index(col, ".", -1))).otherwise(F.lit(""))


def without_extension(col: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    kept = F.length(col) - F.length(F.substring_index(col, ".", -1)) - 1
    return F.when(kept > 0, F.substring(col, F.lit(1), kept)).otherwise(col)


def url_host(col: Column) -> Column:
    """Host of a URL, also without a scheme: scheme, path, port and query cut in
    this order (`parse_url` gives NULL for scheme-less input)."""
    scheme = F.instr(col, "://")
    host = F.when(scheme > 0, F.substring(col, scheme + 3, F.length(col))).otherwise(col)
    for stop in ("/", ":", "?"):
        host = F.substring_index(host, stop, 1)
    return host


def mac_address(col: Column) -> Column:
    bare = F.regexp_replace(col, "[:-]", "")
    return F.when(
        F.length(bare) == 12,
        F.regexp_replace(bare, "^(..)(..)(..)(..)(..)(..)$", "$1:$2:$3:$4:$5:$6"),
    ).otherwise(bare)


def rot13(col: Column) -> Column:
    return F.translate(col, _LOWER + _UPPER, _ROT)


def sid_of_path(col: Column) -> Column:
    return F.regexp_extract(col, r"(?:^|[/\\])(S-1-5-[^/\\]*)", 1)


def rid_of_sid(col: Column) -> Column:
    return F.substring_index(col, "-", -1).try_cast("int")


def snake_case(col: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(col, "(?<!^)([A-Z])", "_$1")), " ", "_")


def redact_secret(name: Column, value: Column) -> Column:
    return F.when(F.lower(name).rlike(SECRET_WORDS), F.lit("[REDACTED]")).otherwise(value)


def join_capped(items: Column, cap: int = 5) -> Column:
    """First `cap` items joined, then how many are left out of the text."""
    extra = F.size(items) - cap
    head = F.array_join(F.slice(items, 1, cap), "; ")
    return F.when(extra > 0, F.concat(head, F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(head)


def printable(col: Column) -> Column:
    """Anything outside printable ASCII becomes a dot."""
    return F.regexp_replace(col, r"[^\x20-\x7e]", ".")
