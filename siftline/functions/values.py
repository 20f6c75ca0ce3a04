"""Booleans, first-of, attribute bags, ranked sets and JSON helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank order of detection scores and of rule levels.
SCORE_RANK = {"NOTABLE": 3, "LIKELY_NOTABLE": 2, "UNKNOWN": 1}
LEVEL_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}

STRING_MAP = "map<string,string>"


def once(col: Column) -> Column:
    """The same value, but evaluated where it stands.

    A filter on a derived column is otherwise moved below it with the whole
    expression copied in, once per mention; for parsed JSON or rule conditions
    the copies cost more than the filter saves. The partition id is never
    negative, and being non-deterministic it keeps the filter above.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def whole_number(col: Column) -> Column:
    """Text or number -> long, NULL when it is no whole number. The pattern
    test comes first: a failing cast costs an exception per row."""
    text = col.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?\d{1,19}\s*$"), text.try_cast("long"))


def real_number(col: Column) -> Column:
    """Text or number -> double, NULL when it is no number."""
    text = col.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def loose_boolean(col: Column) -> Column:
    """True only for true / "true" in any case; NULL and anything else is false."""
    return F.coalesce(F.lower(col.cast("string")) == "true", F.lit(False))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def attribute_map(pairs: dict[str, Column]) -> Column:
    """name -> text map without NULL and empty entries."""
    return drop_empty(raw_map(pairs))


def raw_map(pairs: dict[str, Column]) -> Column:
    """name -> text map with NULL and empty entries still in it."""
    if not pairs:
        return F.expr("cast(map() as map<string,string>)")
    flat = [c for name, value in pairs.items() for c in (F.lit(name), value.cast("string"))]
    return F.create_map(*flat)


def drop_empty(col: Column) -> Column:
    return F.map_filter(col, lambda _, v: v.isNotNull() & (v != ""))


def overlay(base: Column, top: Column) -> Column:
    """Union of two attribute maps; on a shared name `top` wins (see the map
    key policy in `siftline.session`)."""
    return F.map_concat(base, top)


def parse_map(col: Column) -> Column:
    """JSON object text -> map of text values (nested values stay JSON text)."""
    return F.from_json(col, STRING_MAP)


def parse_maps(col: Column) -> Column:
    return F.from_json(col, f"array<{STRING_MAP}>")


def flatten_one_level(col: Column) -> Column:
    """Map whose nested objects are spread as `outer_inner`; arrays are dropped."""
    plain = F.map_filter(col, lambda _, v: ~v.startswith("{") & ~v.startswith("["))
    nested = F.map_entries(F.map_filter(col, lambda _, v: v.startswith("{")))
    inner = F.flatten(
        F.transform(
            nested,
            lambda e: F.transform(
                F.map_entries(F.coalesce(parse_map(e["value"]), F.expr("cast(map() as map<string,string>)"))),
                lambda i: F.struct(
                    F.concat(e["key"], F.lit("_"), i["key"]).alias("key"), i["value"].alias("value")
                ),
            ),
        )
    )
    return overlay(plain, drop_empty(F.map_from_entries(inner)))


def first_application(col: Column) -> Column:
    """First non-empty `application` of a JSON array; otherwise the text itself."""
    apps = F.transform(parse_maps(col), lambda m: m["application"])
    named = F.filter(apps, lambda a: a.isNotNull() & (a != ""))
    return F.coalesce(F.get(named, F.lit(0)), col)


def add_tags(tags: Column, *new: Column) -> Column:
    """Append tags, keeping order and dropping repeats."""
    base = F.coalesce(tags, F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(base, F.array(*new)))


def highest(labels: Column, rank: dict[str, int]) -> Column:
    """Highest-ranked label of an array; with none ranked, the least label."""
    lookup = F.create_map(*[c for k, v in rank.items() for c in (F.lit(k), F.lit(v))])
    keyed = F.transform(
        labels, lambda s: F.struct((-F.coalesce(lookup[s], F.lit(0))).alias("order"), s.alias("label"))
    )
    return F.array_min(keyed)["label"]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def analysis_attributes(results: Column) -> dict[str, Column]:
    """Significance, type, justification and technique ids of the JSON array of
    analysis results, each joined in array order."""
    parsed = F.from_json(
        results,
        "array<struct<significance:string,analysisType:string,justification:string,mitreAttackIds:array<string>>>",
    )

    def joined(name: str, sep: str) -> Column:
        values = F.filter(F.transform(parsed, lambda r: r[name]), lambda v: v != "")
        return F.array_join(values, sep)

    ids = F.flatten(F.transform(parsed, lambda r: F.coalesce(r["mitreAttackIds"], F.expr("cast(array() as array<string>)"))))
    return {
        "ct_significance": joined("significance", ","),
        "ct_analysis_type": joined("analysisType", ","),
        "ct_justification": joined("justification", " | "),
        "mitre_attack_ids": F.array_join(F.filter(ids, lambda v: v != ""), ","),
    }
