"""Quality rules with a robust multivariate outlier test, in DataFrame operations.

Base rules reject texts of few words and texts that repeat their own phrases. The
others are held against documents of their language and source: a vector of
transformed statistics (log mean word length, root of the symbol share, share of
repeated lines, share of repeated words) has a Mahalanobis distance
under the group's minimum-covariance-determinant estimate, and too far is rejected.

The estimate takes concentration steps for all groups at once: mean and covariance
over the nearest `SUPPORT` of a group, new distances, again. It does so from several
fixed starts (`STARTS`: a quantile of every statistic and a scale), and the one that
ends in the least determinant is a group's estimate. Up to a quarter of a group may so
be outliers, wherever they lie; more would be part of any such estimate. Quantiles of a group are read from counts of fine bins, so nothing sorts
or gathers a group, and results do not depend on how rows are spread. Covariances
get `FLOORS` squared on the diagonal: many groups have statistics that hardly vary,
and a difference that is small in itself is no reason to reject. They are narrow
enough for each statistic to reject alone: in a group without repetition, repeated
lines do from 54 % on, repeated words from 38 % on.

A group with fewer than `MIN_GROUP` rows that pass the base rules is judged by
its language, and a language by all rows. Null text: no words, so rejected. Null
language or source: a value of its own. Every input row gives one row; rows that
share an id are judged one by one.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, WORD, written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SUPPORT, STEPS, MIN_GROUP = 0.75, 5, 64
#: Where the concentration steps begin: a quantile of each statistic, and how many of
#: the least standard deviations count as one.
STARTS = ((0.5, 1.0), (0.25, 1.0), (0.75, 1.0), (0.5, 4.0))
#: Least standard deviations that count, in the order of `_vector`.
FLOORS = (0.06, 0.04, 0.10, 0.07)
#: Share of clean documents that a normal vector keeps.
CONFIDENCE = 0.99999
_D = len(FLOORS)
_X = [f"x{i}" for i in range(_D)]
_PAIRS = list(combinations_with_replacement(range(_D), 2))


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return high


CUTOFF = _chi2_quantile(CONFIDENCE, _D)
#: The nearest rows of a normal vector vary less than all; this makes up for it.
_CONSISTENCY = SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, _D), _D + 2)


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    source: str = "source") -> DataFrame:
    """`doc` (the input row as a struct), the key, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, the groups and the vector."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(" \t\n\v\f\r"))
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"),
        F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))).alias("g0"),
        F.to_json(F.struct(F.col(lang).alias("l"))).alias("g1"),
        F.when(bare != "", F.split(bare, SPACES)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda line: F.rlike(line, F.lit(WORD))).alias("lines"),
    )
    df = df.select(
        "doc", "key", "g0", "g1", "n_symbols", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("words").cast("long").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.slice(F.transform(
            "words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
        ), F.lit(1), F.size("words") - 2)).alias("windows"),
    )
    # Most texts repeat no window; only the others are sorted to find where.
    df = df.withColumn("by_hash", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("windows")
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("by_hash", lambda x, i: (
        F.get("by_hash", i - 1)["h"].eqNullSafe(x["h"]) | F.get("by_hash", i + 1)["h"].eqNullSafe(x["h"])
    )), lambda x: x["i"]))).drop("by_hash")
    covered = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")) \
        .drop("at")
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = (
        F.log(chars / n), F.sqrt(F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n,
    )
    # A row number is never negative, but a filter cannot be moved below it and so
    # cannot multiply the expressions above.
    never = F.monotonically_increasing_id() < 0
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    ) | never).withColumns({x: v.cast("double") for x, v in zip(_X, vector, strict=True)}).drop("n_lines")


def _summed_bins(df: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    """Per group its bins with the rows up to each (_to) and in all (_all)."""
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = df.groupBy(*keys, bin_.cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_to", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))


def _bin_quantile(df: DataFrame, keys: list[str], bin_: Column, fraction: float, out: str) -> DataFrame:
    """Per group the bin that holds the quantile: counts of bins, added up."""
    sums = _summed_bins(df, keys, bin_)
    return sums.where(F.col("_to") >= fraction * F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias(out))


def _distance(cov: dict[tuple[int, int], Column], mean: list[Column]) -> Column:
    """Squared Mahalanobis distance of the vector: forward substitution along the
    Cholesky factor, whose entries are columns `c<i><j>`."""
    solved: list[Column] = []
    for i in range(_D):
        rest = F.col(_X[i]) - mean[i]
        for j in range(i):
            rest = rest - cov[i, j] * solved[j]
        solved.append(rest / cov[i, i])
    return sum((s * s for s in solved), F.lit(0.0))


def _cholesky(df: DataFrame) -> DataFrame:
    """Columns v<i><j> (covariances) to columns c<i><j> (their factor)."""
    for i in range(_D):
        for j in range(i + 1):
            v = F.col(f"v{j}{i}")
            for k in range(j):
                v = v - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            df = df.withColumn(f"c{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4))) if i == j else v / F.col(f"c{j}{j}"))
    return df


_PARAMETERS = ["g", *[f"m{i}" for i in range(_D)], *[f"c{i}{j}" for i in range(_D) for j in range(i + 1)]]


def _by_parameters() -> Column:
    return _distance({(i, j): F.col(f"c{i}{j}") for i in range(_D) for j in range(i + 1)}, [F.col(f"m{i}") for i in range(_D)])


def fit(stats: DataFrame) -> DataFrame:
    """Parameters per group key `g`, from rows of `with_statistics`: mean and
    Cholesky factor. Groups that are too small have none."""
    passed = stats.where(~F.col("base_failed")).select("g0", "g1", *_X)
    sizes = passed.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < MIN_GROUP).groupBy("g1").agg(F.lit(True).alias("has_small"))
    langs = sizes.groupBy("g1").agg(F.sum("n").alias("n1")).join(small, "g1", "left")
    # A row counts for its group, and for its language and all where those are needed.
    narrow = F.col("has_small") & (F.col("n1") < MIN_GROUP)
    need_all = not langs.where(narrow).isEmpty()
    wanted = sizes.join(langs, "g1").select("g0", F.filter(F.array(
        F.when(F.col("n") >= MIN_GROUP, F.col("g0")),
        F.when(F.col("has_small") & (F.col("n1") >= MIN_GROUP), F.col("g1")),
        F.lit("all" if need_all else None).cast("string"),
    ), lambda g: g.isNotNull()).alias("gs"))
    rows = passed.join(wanted, "g0").select(F.explode("gs").alias("g"), *_X)

    rows = written(rows, "quality-rows")
    bins = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) / (f / 8)) for x, f in zip(_X, FLOORS, strict=True)])).alias("d", "b"))
    # All quantiles in one pass, then a row a group and start.
    sums = _summed_bins(bins, ["g", "d"], F.col("b"))
    at = sums.groupBy("g", "d").agg(*[F.min(F.when(F.col("_to") >= q * F.col("_all"), F.col("_bin"))).alias(f"q{s}") for s, (q, _) in enumerate(STARTS)])
    centers = at.groupBy("g").agg(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(scale).alias("scale"), *[
        ((F.max(F.when(F.col("d") == i, F.col(f"q{s}"))) + 0.5) * (FLOORS[i] / 8)).alias(f"m{i}") for i in range(_D)
    ]) for s, (_, scale) in enumerate(STARTS)]).alias("starts")).select("g", F.inline("starts"))
    parameters = centers.withColumns({
        f"c{i}{j}": FLOORS[i] * F.col("scale") if i == j else F.lit(0.0) for i in range(_D) for j in range(i + 1)})
    for _ in range(STEPS):
        # Tables of a row a group and start, whose size Spark sees before it joins.
        parameters = written(parameters.select("s", *_PARAMETERS), "quality-step")
        placed = rows.join(parameters, "g").withColumn("d2", _by_parameters()).withColumn(
            "bin", F.floor(F.log2(F.col("d2") + 1e-6) * 32))
        edges = written(_bin_quantile(placed, ["g", "s"], F.col("bin"), SUPPORT, "edge"), "quality-edges")
        near = placed.join(edges, ["g", "s"]).where(F.col("bin") <= F.col("edge"))
        sums = near.groupBy("g", "s").agg(
            *[F.avg(F.col(_X[i]) - F.col(f"m{i}")).alias(f"a{i}") for i in range(_D)],
            *[F.avg((F.col(_X[i]) - F.col(f"m{i}")) * (F.col(_X[j]) - F.col(f"m{j}"))).alias(f"p{i}{j}") for i, j in _PAIRS],
            *[F.first(f"m{i}").alias(f"m{i}") for i in range(_D)],
        )
        parameters = _cholesky(sums.select("g", "s", *[(F.col(f"m{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(_D)], *[
            (_CONSISTENCY * (F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"v{i}{j}")
            for i, j in _PAIRS]))
    # As a table first, or the factors' nested expressions would be written out again.
    parameters = written(parameters.select("s", *_PARAMETERS), "quality-step")
    # The least determinant, in steps that no rounding reaches; then the first start.
    size = F.round(sum((F.log(f"c{i}{i}") for i in range(_D)), F.lit(0.0)), 6)
    best = parameters.groupBy("g").agg(F.min_by(F.struct(*_PARAMETERS[1:]), F.struct(size, "s")).alias("best")).select("g", "best.*")
    return written(best.select(*_PARAMETERS), "quality-parameters")


def judge(stats: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds `distance2` (null: no group is large enough) and `kept`."""
    def named(prefix: str) -> DataFrame:
        return parameters.select(*[F.col(c).alias(f"{prefix}{c}") for c in _PARAMETERS])

    joined = stats.join(named("a_"), F.col("g0") == F.col("a_g"), "left").join(named("b_"), F.col("g1") == F.col("b_g"), "left")
    of_all = parameters.where("g = 'all'").first()
    picked = joined.withColumns({c: F.coalesce(f"a_{c}", f"b_{c}", F.lit(of_all and of_all[c])) for c in _PARAMETERS})
    return picked.withColumn("distance2", _by_parameters()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    ).select(*stats.columns, "distance2", "kept")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def verdicts(docs: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """One row per input row: key, the statistics, base_failed, distance2, kept."""
    stats = written(with_statistics(docs, key, **columns).drop("doc"), "quality")
    return judge(stats, fit(stats)).select(F.col("key").alias(key), *_COUNTS, "distance2", "kept")


def keep_good(docs: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """The input rows that are kept. Statistics are made once more for it, which
    is cheaper than writing or joining the texts."""
    stats = with_statistics(docs, key, **columns)
    parameters = fit(written(stats.drop("doc"), "quality"))
    return judge(stats, parameters).where("kept").select("doc.*")
