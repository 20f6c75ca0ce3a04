"""Turning decoded records into events.

A record frame has the capture keys (`upload_id`, `site_id`, `host_name`,
`seq`), the capture's `collection_ts`, and `rec`, a map of text fields. An
`Emit` says how one kind of record becomes events; `build` applies it as a
projection (plus an explode where one record gives several events). `emit`
then normalises and deduplicates.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.values import attribute_map, drop_empty, once, overlay, raw_map
from siftline.schema import DEDUPE_KEY, EVENT_COLUMNS, EVENT_SCHEMA

Text = str | Column


def rec(name: str) -> Column:
    """Field of the record, '' when absent."""
    return F.coalesce(F.col("rec")[name], F.lit(""))


def say(template: str, **extra: Column) -> Column:
    """`"Running: {name}"` -> concat of literals and record fields."""
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(F.coalesce(extra[name].cast("string"), F.lit("")) if name in extra else rec(name))
    return F.concat(*pieces) if pieces else F.lit("")


def opt(template: str, **extra: Column) -> Column:
    """Like `say`, but empty when any named field is empty."""
    names = [n for _, n, _, _ in string.Formatter().parse(template) if n]
    filled = reduce(
        lambda a, b: a & b,
        [(F.coalesce(extra[n].cast("string"), F.lit("")) if n in extra else rec(n)) != "" for n in names],
    )
    return F.when(filled, say(template, **extra)).otherwise(F.lit(""))


def collected() -> Column:
    return F.col("collection_ts")


def _text(value: Text) -> Column:
    return F.lit(value) if isinstance(value, str) else value


@dataclass
class Emit:
    """How one kind of record becomes events.

    `times` lists (timestamp, description[, word]) candidates: by default the
    first non-NULL one is used; with `fan_out` every non-NULL one gives an event.
    `message` may use `word()` for the third element. `attrs` maps attribute
    names to record fields (text) or Columns; `spread` adds a whole map. With
    `fan_out`, `attrs` is evaluated once per record, before the explode;
    attributes that use `word()` go into `event_attrs`.
    """

    event_type: Text
    data_type: Text
    message: Column
    times: list[tuple]
    source: tuple[Text, Text]
    attrs: dict[str, Text] = field(default_factory=dict)
    event_attrs: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None
    fan_out: bool = False
    spread: Column | None = None
    significance: Column | None = None
    suspicious: Column | None = None
    #: The whole text where the message shows a part of it.
    whole: Column | None = None


def word() -> Column:
    return F.col("_at.word")


def described() -> Column:
    return F.col("_at.desc")


def build(df: DataFrame, spec: Emit) -> DataFrame:
    """Apply one `Emit` to a record frame."""
    if spec.where is not None:
        df = df.where(spec.where)
    stamps = [
        F.struct(
            t[0].cast("timestamp").alias("ts"),
            _text(t[1]).alias("desc"),
            _text(t[2] if len(t) > 2 else "").alias("word"),
        )
        for t in spec.times
    ]
    pairs = {k: (rec(v) if isinstance(v, str) else v) for k, v in spec.attrs.items()}
    # `once` keeps the map and the times in generated code: inside the lambda of
    # `map_filter` Spark would interpret the expressions they are made of.
    df = df.withColumn("_attrs", once(raw_map(pairs)))
    if spec.fan_out:
        df = df.withColumn("_at", F.explode(F.array(*stamps))).where(F.col("_at.ts").isNotNull())
    else:
        first = F.coalesce(*[F.when(s["ts"].isNotNull(), s) for s in stamps])
        df = df.withColumn("_at", first).where(F.col("_at.ts").isNotNull())
    attrs = drop_empty(F.col("_attrs"))
    if spec.event_attrs:
        attrs = F.map_concat(attrs, attribute_map(spec.event_attrs))
    if spec.spread is not None:
        attrs = overlay(attrs, drop_empty(spec.spread))
    return df.select(
        "upload_id", "site_id", "host_name", "seq",
        F.timestamp_millis(F.unix_millis(F.col("_at.ts"))).alias("datetime"),
        F.col("_at.desc").alias("timestamp_desc"),
        spec.message.alias("message"),
        _text(spec.event_type).alias("event_type"),
        F.coalesce(F.when(_text(spec.data_type) != "", _text(spec.data_type)), F.lit("ct:generic:event")).alias("data_type"),
        _text(spec.source[0]).alias("source_short"),
        _text(spec.source[1]).alias("source_long"),
        (spec.significance if spec.significance is not None else F.lit(None).cast("string")).alias("ct_significance"),
        (F.coalesce(spec.suspicious, F.lit(False)) if spec.suspicious is not None else F.lit(False)).alias("is_suspicious"),
        attrs.alias("attrs"),
        (F.lit(None).cast("string") if spec.whole is None else F.md5(spec.whole.cast("binary"))).alias("content"),
    )


def build_all(df: DataFrame, specs: list[Emit]) -> DataFrame:
    return concat_events([build(df, s) for s in specs])


def concat_events(frames: list[DataFrame]) -> DataFrame:
    """One timeline out of many builders' events."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_digest(keys: list[str], salt: int) -> Column:
    """64 bits of the key; (x, NULL) and (NULL, x) are told apart."""
    return F.xxhash64(F.lit(salt), *[c for k in keys for c in (F.col(k), F.col(k).isNull())])


def emit(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Deduplicate: one event per key, the first in source order wins.

    Rows meet under 128 bits of the key, two numbers, so sorting and comparing them
    touches no text. The winner is picked by `seq` (and, of one record's, by a digest of
    the row) with an aggregate that combines on the map side: a key that holds a large
    share of all rows shrinks to one row per task before the shuffle. A window would
    send them all to one.
    """
    keys = [k for k in keys or DEDUPE_KEY if k in df.columns]
    plain = [c for c in df.columns if not _is_map(df, c)]
    order = F.struct("seq", F.xxhash64(*plain, *[F.array_sort(F.map_keys(c)) for c in df.columns if c not in plain]))
    kept = (
        df.where(F.col("datetime").isNotNull())
        .groupBy(key_digest(keys, 1).alias("_k1"), key_digest(keys, 2).alias("_k2"))
        .agg(F.min_by(F.struct(*df.columns), order).alias("_first"))
    )
    return kept.select("_first.*")


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "map"


def first_in_order(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """First row per key in the given order, combined on the map side."""
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def builder(kind: str):
    """Register `DataFrame -> event DataFrame` under the record kind it reads."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        if kind in BUILDERS:
            raise ValueError(f"builder {kind!r} is already registered")
        BUILDERS[kind] = fn
        return fn

    return add


def run_all(frames: dict[str, DataFrame]) -> DataFrame:
    """Run the registered builder of every kind present, in name order, and
    union the results into one deduplicated timeline."""
    unknown = sorted(set(frames) - set(BUILDERS))
    if unknown:
        raise KeyError(f"no builder for {unknown}")
    return emit(concat_events([BUILDERS[k](frames[k]) for k in sorted(frames)]))


def empty_events(spark) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA).select(*EVENT_COLUMNS)
