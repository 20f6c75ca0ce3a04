"""Browser databases (decoded tables as record frames) -> events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import base_name, ellipsis
from siftline.functions.times import iso_ms, mac_absolute, unix_micros, webkit_micros
from siftline.functions.values import overlay, whole_number
from siftline.operators.build import Emit, build, builder, collected, rec, say

LINUX = "Collector-Linux"
MACOS = "Collector-macOS"
DB_KEYS = ["upload_id", "site_id", "host_name", "db_path"]

BROWSER_WORDS = ["chrome", "chromium", "brave", "vivaldi", "edge", "opera", "firefox"]


def newest_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, salts: int = 64, tie: Column | None = None
) -> DataFrame:
    """First `n` rows per group in the given order, exactly.

    Two rounds: the first ranks inside `salts` slices of each group and keeps n
    of each, the second ranks the survivors. However large a group, no task of
    the second round sees more than `salts * n` of its rows.
    """
    keys = [*order, *([tie] if tie is not None else [])]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*keys)
    second = Window.partitionBy(*group).orderBy(*keys)
    kept = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    return kept.withColumn("_rn", F.row_number().over(second)).where(F.col("_rn") <= n).drop("_rn", "_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def join_visits(visits: DataFrame, urls: DataFrame, visit_key: str, url_key: str) -> DataFrame:
    """Visits with the fields of their URL row (`rec` of both, the visit's win)."""
    left = visits.withColumn("_id", rec(visit_key))
    right = urls.select(*DB_KEYS, rec(url_key).alias("_id"), F.col("rec").alias("_url"))
    return left.join(right, [*DB_KEYS, "_id"]).withColumn("rec", overlay(F.col("_url"), F.col("rec"))).drop("_id", "_url")


def browser_of_path(path: Column) -> Column:
    text = F.lower(path)
    chain = F.when(F.lit(False), F.lit(""))
    for w in BROWSER_WORDS:
        chain = chain.when(text.contains(w), F.lit(w.capitalize()))
    return chain.otherwise(F.lit("Unknown"))


def _titled(lead: str) -> Column:
    shown = ellipsis(rec("url"), 150)
    return F.concat(F.lit(lead), F.when(rec("title") != "", say("{title} ({s})", s=shown)).otherwise(shown))


def _linux(kind: str, desc: str, message: Column, at: Column, browser: Column, event_type: str, **attrs) -> Emit:
    return Emit(
        event_type=event_type, data_type=f"linux:browser:{kind}", message=message,
        times=[(at, desc), (collected(), desc)],
        source=(LINUX, F.concat(F.lit("Linux Collector - "), browser)), attrs=attrs | {"browser": browser},
        whole=rec("url") if kind == "history" else None,
    )


def _whole(name: str) -> Column:
    return F.coalesce(whole_number(rec(name)), F.lit(0))


@builder("linux.chromium_visits")
def linux_chromium_visits(df: DataFrame) -> DataFrame:
    """Visits joined to URLs (`join_visits`). All rows are read; `newest_per_group` cuts them where asked to."""
    return build(df, _linux(
        "history", "Web History Entry", _titled("Web visit: "), webkit_micros(rec("visit_time")),
        browser_of_path(F.col("db_path")), "web_history", url="url", title="title", visit_count="visit_count",
    ))


@builder("linux.chromium_downloads")
def linux_chromium_downloads(df: DataFrame) -> DataFrame:
    return build(df, _linux(
        "download", "File Downloaded", say("Downloaded: {b} from {tab_url}", b=base_name(rec("target_path"))),
        webkit_micros(rec("start_time")), browser_of_path(F.col("db_path")), "web_download",
        file_path="target_path", source_url="tab_url", total_bytes="total_bytes", state="state",
    ))


@builder("linux.chromium_cookies")
def linux_chromium_cookies(df: DataFrame) -> DataFrame:
    return build(df, _linux(
        "cookie", "Web Cookie", say("Cookie: {name} on {host_key}"), webkit_micros(rec("last_access_utc")),
        browser_of_path(F.col("db_path")), "web_cookie", host="host_key", name="name", path="path",
        is_secure=rec("is_secure") == "1", is_httponly=rec("is_httponly") == "1",
    ))


@builder("linux.chromium_logins")
def linux_chromium_logins(df: DataFrame) -> DataFrame:
    return build(df, _linux(
        "login", "Web Login Saved", say("Saved login: {username_value} @ {origin_url}"),
        webkit_micros(rec("date_last_used")), browser_of_path(F.col("db_path")), "web_login",
        url="origin_url", username="username_value", times_used="times_used",
    ))


@builder("linux.firefox_places")
def linux_firefox_places(df: DataFrame) -> DataFrame:
    df = df.where(rec("last_visit_date") != "")
    return build(df, _linux(
        "history", "Web History Entry", _titled("Web visit: "), unix_micros(rec("last_visit_date")),
        F.lit("Firefox"), "web_history", url="url", title="title", visit_count="visit_count",
    ))


@builder("linux.firefox_cookies")
def linux_firefox_cookies(df: DataFrame) -> DataFrame:
    return build(df, _linux(
        "cookie", "Web Cookie", say("Cookie: {name} on {host}"), unix_micros(rec("lastAccessed")),
        F.lit("Firefox"), "web_cookie", host="host", name="name", path="path",
        is_secure=rec("isSecure") == "1", is_httponly=rec("isHttpOnly") == "1",
    ))


# ---------------------------------------------------------------------- macOS

def _page() -> Column:
    return F.when(rec("title") != "", say("{title} ({url})")).otherwise(rec("url"))


def _macos(kind: Column | str, desc: str, message: Column, at: Column, event_type: str, part: Column | str, **attrs) -> Emit:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    part = F.lit(part) if isinstance(part, str) else part
    return Emit(
        event_type=event_type, data_type=F.concat(F.lit("darwin:browser:"), kind), message=message,
        times=[(at, desc), (collected(), desc)],
        source=(MACOS, F.concat(F.lit("macOS Collector - "), part)), attrs=attrs | {"username": "user"},
    )


def _of_browser(kind: str) -> Column:
    return say("{browser}:" + kind)


@builder("macos.safari_visits")
def safari_visits(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        "safari:history", "Web Page Visited", _page(), mac_absolute(rec("visit_time")), "web_history", "Safari History",
        browser=F.lit("safari"), url="url", title="title", domain="domain_expansion",
        load_ok=_whole("load_successful"), profile=F.lit("default"),
    ))


@builder("macos.chromium_visits")
def chromium_visits(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        _of_browser("history"), "Web Page Visited", _page(), webkit_micros(rec("visit_time")), "web_history",
        say("{browser} History"), browser="browser", url="url", title="title",
        **{n: _whole(n) for n in ("visit_count", "typed_count", "transition")},
    ))


@builder("macos.chromium_downloads")
def chromium_downloads(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        _of_browser("download"), "File Downloaded", say("Download: {target_path} <- {tab_url}"),
        webkit_micros(rec("start_time")), "web_download", say("{browser} Downloads"), browser="browser",
        target_path="target_path", source_url="tab_url", mime_type="mime_type",
        total_bytes=_whole("total_bytes"), state=_whole("state"),
    ))


@builder("macos.chromium_cookies")
def chromium_cookies(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        _of_browser("cookie"), "Cookie Created", say("Cookie {name} on {host_key}"),
        webkit_micros(rec("creation_utc")), "web_cookie", say("{browser} Cookies"), browser="browser",
        host="host_key", name="name", path="path",
        **{n: _whole(n) for n in ("expires_utc", "is_secure", "is_httponly")},
    ))


@builder("macos.chromium_logins")
def chromium_logins(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        _of_browser("login"), "Web Login Saved", say("Login saved: {username_value} @ {origin_url}"),
        webkit_micros(rec("date_created")), "web_login", say("{browser} Login Data"), browser="browser",
        origin_url="origin_url", action_url="action_url", login_user="username_value",
        signon_realm="signon_realm", times_used=_whole("times_used"),
        last_used=iso_ms(webkit_micros(rec("date_last_used"))),
    ))


@builder("macos.firefox_visits")
def firefox_visits(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        "firefox:history", "Web Page Visited", _page(), unix_micros(rec("visit_date")), "web_history",
        "Firefox places", browser=F.lit("firefox"), url="url", title="title",
        **{n: _whole(n) for n in ("visit_count", "typed", "visit_type")},
    ))


@builder("macos.firefox_cookies")
def firefox_cookies(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        "firefox:cookie", "Cookie Created", say("Cookie {name} on {host}"), unix_micros(rec("creationTime")),
        "web_cookie", "Firefox Cookies", browser=F.lit("firefox"), host="host", name="name", path="path",
        expiry=_whole("expiry"), is_secure=_whole("isSecure"), is_httponly=_whole("isHttpOnly"),
    ))


@builder("macos.firefox_forms")
def firefox_forms(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        "firefox:form", "Form Field Filled", say("Form value: {fieldname} = {value}"), unix_micros(rec("lastUsed")),
        "form_history", "Firefox FormHistory", browser=F.lit("firefox"), field_name="fieldname", value="value",
        times_used=_whole("timesUsed"), first_used=iso_ms(unix_micros(rec("firstUsed"))),
    ))


@builder("macos.firefox_downloads")
def firefox_downloads(df: DataFrame) -> DataFrame:
    return build(df, _macos(
        "firefox:download", "File Downloaded", say("Download: {target} <- {source}"), unix_micros(rec("startTime")),
        "web_download", "Firefox Downloads", browser=F.lit("firefox"), name="name", source_url="source",
        target_path="target", state=_whole("state"), total_bytes=_whole("maxBytes"),
    ))


# -------------------------------------------------------------------- Windows

def _windows(browser: Column | str, desc: str, data_type: str, at: Column, **attrs) -> Emit:
    name = F.lit(browser) if isinstance(browser, str) else browser
    return Emit(
        event_type="browser_history", data_type=data_type,
        message=F.concat(name, F.lit(": "), F.when(rec("title") != "", say("{title} ({url})")).otherwise(rec("url"))),
        times=[(at, desc)], source=("CT-Browser", F.concat(F.lit("Browser - "), name)),
        attrs={
            "url": "url", "title": "title", "visit_count": "visit_count", "browser": name,
            "source_path": F.col("db_path"),
        } | attrs,
    )


@builder("windows.chromium_urls")
def windows_chromium_urls(df: DataFrame) -> DataFrame:
    path = F.col("db_path")
    name = F.when(path.contains("Edge") | path.contains("edge"), F.lit("Edge")).otherwise(F.lit("Chrome"))
    user = F.regexp_extract(base_name(path), "^([^_]+)_", 1)
    return build(df.where(_whole("last_visit_time") > 0), _windows(
        name, "URL Last Visited", "chrome:history:page_visited", webkit_micros(rec("last_visit_time")), user_id=user,
    ))


@builder("windows.firefox_visits")
def windows_firefox_visits(df: DataFrame) -> DataFrame:
    return build(df.where(_whole("visit_date") > 0), _windows(
        "Firefox", "URL Visited", "firefox:places:page_visited", unix_micros(rec("visit_date")),
    ))
