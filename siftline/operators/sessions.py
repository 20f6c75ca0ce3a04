"""Session report: logon sessions, terminal sessions, failed logons.

Sessions are keyed within their capture. Folds take the last non-empty value in
source order (`seq`), by map-side-combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.labels import logon_type
from siftline.functions.times import iso_ms
from siftline.operators.filters import attr

# Event ids and addresses the report knows.
LOGON_IDS, LOGOFF_IDS, FAILED_ID = ["4624", "4672"], ["4634", "4647"], "4625"
LOCAL_ADDRESSES = ["-", "", "127.0.0.1", "::1"]
HANDS_ON_TYPES = ["2", "10"]

REPORT = [
    "session_id", "logon_id", "connection_type", "username", "domain", "source_ip", "source_hostname",
    "target_hostname", "logon_time", "logoff_time", "duration_seconds", "logon_type", "logon_type_desc",
    "authentication_method", "logon_process", "workstation_name", "event_ids", "data_source", "hostname",
]


def connection_type(event_type: Column, logon: Column, address: Column, ip: Column) -> Column:
    """Interactive Console, RDP, Network or Unknown."""
    local = (address == "LOCAL") | ip.isin(LOCAL_ADDRESSES)
    return (
        F.when((event_type == "windows_rdp") & (address == "LOCAL"), F.lit("Interactive Console"))
        .when(event_type.isin("windows_rdp", "rdp_connection"), F.lit("RDP"))
        .when(logon == "10", F.lit("RDP"))
        .when((logon == "2") & local, F.lit("Interactive Console"))
        .when(logon == "2", F.lit("RDP"))
        .when(logon == "3", F.lit("Network"))
        .otherwise(F.lit("Unknown"))
    )


def _fields(df: DataFrame) -> DataFrame:
    def a(*names: str) -> Column:
        return F.coalesce(*[F.when(attr(df, n) != "", attr(df, n)) for n in names])

    address, ip = F.coalesce(a("Address"), F.lit("")), F.coalesce(a("IpAddress"), F.lit(""))
    return df.select(
        "upload_id", "seq", "datetime", "event_type", F.coalesce("host_name", F.lit("")).alias("host"),
        a("event_identifier").alias("eid"), a("TargetLogonId", "LogonID", "LogonId").alias("logon_id"),
        a("SessionID").alias("session_id"), a("TargetUserName", "SubjectUserName").alias("account"),
        a("TargetDomainName", "SubjectDomainName").alias("domain"), ip.alias("ip"),
        a("WorkstationName").alias("workstation"), a("LogonType").alias("logon_type"),
        a("AuthenticationPackageName").alias("package"), a("LogonProcessName").alias("process"),
        a("User").alias("user"), a("SubStatus").alias("failure"), a("entries").alias("remote_host"),
        a("username").alias("remote_user"), a("remote_domain").alias("remote_domain"), a("local_user").alias("local_user"),
        connection_type(F.col("event_type"), F.coalesce(a("LogonType"), F.lit("")), address, ip).alias("connection"),
    )


def _last(col: str, when: Column | None = None) -> Column:
    value = F.col(col)
    keep = value.isNotNull() if when is None else value.isNotNull() & when
    return F.max_by(value, F.when(keep, F.col("seq")))


def logon_sessions(f: DataFrame) -> DataFrame:
    """One row per (capture, logon id) out of logon and logoff events."""
    on, off = F.col("eid").isin(LOGON_IDS), F.col("eid").isin(LOGOFF_IDS)
    address = F.when(F.col("ip") != "-", F.col("ip"))
    return (
        f.where((F.col("event_type") == "windows_logon") & (on | off) & F.col("logon_id").isNotNull())
        .withColumn("address", address)
        .groupBy("upload_id", "logon_id")
        .agg(
            *[_last(c, on).alias(o) for c, o in (
                ("session_id", "session_id"), ("account", "username"), ("domain", "domain"), ("address", "source_ip"),
                ("workstation", "workstation_name"), ("host", "hostname"), ("logon_type", "logon_type"),
                ("package", "authentication_method"), ("process", "logon_process"),
            )],
            _last("datetime", on).alias("logon_time"), _last("datetime", off).alias("logoff_time"),
            F.min_by("connection", F.when(on, F.col("seq"))).alias("connection_type"),
            F.collect_set("eid").alias("event_ids"),
        )
    )


def terminal_events(f: DataFrame) -> DataFrame:
    # The user follows the first backslash.
    user = F.regexp_replace(F.coalesce("user", F.lit("")), r"^[^\\]*\\", "")
    return f.where(F.col("event_type") == "windows_rdp").withColumn("account", F.when(user != "", user))


def terminal_users(t: DataFrame) -> DataFrame:
    """One row per (capture, session id, user) out of terminal events, with the
    facts of the whole session id (`o_*`) on the row of its last user."""
    on, off = F.col("eid") == "21", F.col("eid") == "23"
    per_user = (
        t.where(F.col("session_id").isNotNull())
        .groupBy("upload_id", "session_id", F.col("account").alias("username"))
        .agg(
            F.collect_set("eid").alias("t_ids"), F.min_by("connection", "seq").alias("t_connection"),
            F.max(F.when(on, F.struct("seq", "datetime"))).alias("on"), F.max(F.when(off, F.struct("seq", "datetime"))).alias("off"),
            F.max(F.when(on | off, F.struct("seq", "connection"))).alias("last"),
        )
    )
    # Post-aggregation rows: a session id has as many as it has users.
    whole = Window.partitionBy("upload_id", "session_id")
    named = F.when(F.col("username").isNotNull(), F.col("last.seq"))
    owner = F.max_by("username", named).over(whole)
    facts = F.when(F.col("username") == owner, F.struct(
        F.max("on").over(whole)["datetime"].alias("logon"), F.max("off").over(whole)["datetime"].alias("logoff"),
        F.max("last").over(whole)["connection"].alias("connection"),
    ))
    return per_user.withColumn("own", facts).where(F.col("username").isNotNull()).select(
        "upload_id", "session_id", "username", "t_ids", "t_connection", F.col("on.datetime").alias("t_logon"),
        F.col("off.datetime").alias("t_logoff"), "own",
    )


def merge_terminal(sessions: DataFrame, t: DataFrame) -> DataFrame:
    """Terminal events go into the logon session of the same session id and
    user; terminal sessions without one become sessions of their own. One full
    outer join decides both."""
    no_ids = F.expr("cast(array() as array<string>)")
    # Many logon sessions carry no session id. They match nothing; keyed by
    # their own logon id they stay spread instead of meeting as NULLs.
    matchable = F.col("session_id").isNotNull() & F.col("username").isNotNull()
    key = F.when(matchable, F.struct("session_id", "username")).otherwise(
        F.struct(F.concat(F.lit("\u0000"), "logon_id").alias("session_id"), F.lit("").alias("username"))
    )
    left = sessions.withColumn("_key", key)
    right = terminal_users(t).select(
        "upload_id", F.struct("session_id", "username").alias("_key"), "t_ids", "t_connection", "t_logon", "t_logoff", "own"
    )
    joined = left.join(right, ["upload_id", "_key"], "full_outer")
    alone = F.col("logon_id").isNull()
    joined = joined.withColumn("session_id", F.when(alone, F.col("_key.session_id")).otherwise(F.col("session_id"))).withColumn(
        "username", F.when(alone, F.col("_key.username")).otherwise(F.col("username"))
    )

    def either(own: Column, merged: Column) -> Column:
        return F.when(alone, own).otherwise(merged)

    columns = {
        "logon_id": either(F.concat(F.lit("rdp_"), "session_id"), F.col("logon_id")),
        "domain": either(F.lit(""), F.col("domain")),
        "logon_time": either(F.col("own.logon"), F.coalesce("logon_time", "t_logon")),
        "logoff_time": either(F.col("own.logoff"), F.greatest("logoff_time", "t_logoff")),
        "connection_type": either(F.col("own.connection"), F.coalesce("connection_type", "t_connection")),
        "logon_type": either(F.lit("10"), F.col("logon_type")),
        "event_ids": either(F.array(F.lit("rdp_terminal")), F.array_union("event_ids", F.coalesce("t_ids", no_ids))),
    }
    kept = joined.where(~alone | F.col("own.logon").isNotNull())
    untouched = [c for c in kept.columns if c not in {*columns, "_key", "t_ids", "t_connection", "t_logon", "t_logoff", "own"}]
    return kept.select(*untouched, *[c.alias(n) for n, c in columns.items()], F.lit("EventLog").alias("data_source"))


def registry_sessions(f: DataFrame) -> DataFrame:
    """Remote-desktop client history: one session per user, host and time."""
    rows = f.where(F.col("event_type") == "rdp_connection")
    user = F.coalesce("remote_user", "local_user")
    name = F.concat_ws("@", F.coalesce("local_user", F.lit("")), F.coalesce("remote_host", F.lit("")), iso_ms(F.col("datetime")))
    return rows.groupBy("upload_id", name.alias("logon_id")).agg(
        F.max_by(user, "seq").alias("username"), F.max_by("remote_domain", "seq").alias("domain"),
        F.max_by("remote_host", "seq").alias("workstation_name"), F.max_by("host", "seq").alias("hostname"),
        F.max("datetime").alias("logon_time"),
    ).select(
        "*", F.lit("10").alias("logon_type"), F.lit("RDP").alias("connection_type"),
        F.array(F.lit("registry")).alias("event_ids"), F.lit("Registry").alias("data_source"),
    )


def failed_logons(f: DataFrame) -> DataFrame:
    """Failed hands-on logons, one row each."""
    rows = f.where((F.col("event_type") == "windows_logon") & (F.col("eid") == FAILED_ID) & F.col("logon_type").isin(HANDS_ON_TYPES))
    return rows.select(
        "upload_id", F.lit("").alias("logon_id"), F.lit("Failed Logon").alias("connection_type"),
        F.col("account").alias("username"), "domain", F.when(F.col("ip") != "-", F.col("ip")).alias("source_ip"),
        F.col("workstation").alias("workstation_name"), F.col("host").alias("hostname"),
        F.col("datetime").alias("logon_time"), "logon_type", F.array("eid").alias("event_ids"),
        F.lit("EventLog").alias("data_source"),
    )


def session_report(df: DataFrame) -> DataFrame:
    """All hands-on sessions of the captures, with durations in seconds."""
    f = _fields(df)
    t = terminal_events(f)
    found = merge_terminal(logon_sessions(f), t).unionByName(registry_sessions(f), allowMissingColumns=True)
    hands_on = F.col("logon_type").isin(HANDS_ON_TYPES)
    kind = F.coalesce("connection_type", F.lit("Unknown"))
    found = found.where((kind != "Network") & ((kind != "Unknown") | F.coalesce(hands_on, F.lit(False)))).withColumn(
        "connection_type",
        F.when((kind == "Unknown") & (F.col("logon_type") == "2"), F.lit("Interactive Console"))
        .when(kind == "Unknown", F.lit("RDP")).otherwise(kind),
    )
    return _report(found.unionByName(failed_logons(f), allowMissingColumns=True))


def _report(found: DataFrame) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    seconds = F.when(
        F.col("connection_type") != "Failed Logon",
        F.call_function("div", F.unix_millis("logoff_time") - F.unix_millis("logon_time"), F.lit(1000).cast("long")),
    )
    return found.select(
        "upload_id", text("session_id").alias("session_id"), text("logon_id").alias("logon_id"), "connection_type",
        text("username").alias("username"), text("domain").alias("domain"), text("source_ip").alias("source_ip"),
        text("workstation_name").alias("source_hostname"), text("hostname").alias("target_hostname"),
        F.coalesce(iso_ms(F.col("logon_time")), F.lit("")).alias("logon_time"),
        F.coalesce(iso_ms(F.col("logoff_time")), F.lit("")).alias("logoff_time"), seconds.alias("duration_seconds"),
        text("logon_type").alias("logon_type"),
        F.when(F.col("logon_type").isNotNull(), logon_type(F.col("logon_type"))).otherwise(F.lit("")).alias("logon_type_desc"),
        text("authentication_method").alias("authentication_method"), text("logon_process").alias("logon_process"),
        text("workstation_name").alias("workstation_name"), F.array_join(F.array_sort("event_ids"), ",").alias("event_ids"),
        "data_source", text("hostname").alias("hostname"),
    )


def session_summary(report: DataFrame) -> DataFrame:
    """Counts per connection type and per data source, and sessions with a
    duration."""
    done = F.col("connection_type") != "Failed Logon"
    facets = F.flatten(F.array(
        F.array(F.struct(F.lit("type").alias("facet"), F.col("connection_type").alias("value"))),
        F.transform(F.split("data_source", ","), lambda s: F.struct(F.lit("source").alias("facet"), s.alias("value"))),
        F.when(done & (F.col("duration_seconds") != 0), F.array(F.struct(F.lit("with").alias("facet"), F.lit("duration").alias("value"))))
        .otherwise(F.expr("cast(array() as array<struct<facet:string,value:string>>)")),
    ))
    return report.select(F.inline(facets)).where(F.col("value") != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
