"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are counted by membership pattern
(the set of their sources); word capacity is routed from the patterns to the
sources' quotas; a pattern's second and third repetition cost more than its
first, so words are repeated only where a quota cannot be met otherwise. What a
pattern has to give is then taken from its documents in a seeded order.

Patterns (and so sources) are bounded by `max_patterns`; more raise an error,
since that many sources are no mix. Only the table of patterns reaches the
driver; documents are chosen by a radix search for the cut in the seeded order,
which never orders a source in one task. Rows that share key and text stand at one
place of that order.

A null source is a source of its own, last in order. A null or blank text has
size 0 and nothing is taken from it. Rows that share an id count one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import count_words, written

MAX_PATTERNS = 4096
#: Cost of a pattern's first, second and third taking of its words.
REPEAT_COSTS = (1, 3, 5)
_LEVEL_BITS, _LEVELS = 8, 3


def targets_for(sizes: dict[str | None, int], weights: Sequence[float], limit: int) -> dict[str | None, float]:
    """Every source's share of all words by weight. Sources are taken by code
    point, null last, and get the weights in turn. A target stops at `limit`
    times its source's size; what is over is shared again among the others by
    weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > limit * sizes[s]]
        if not full:
            return targets | share
        targets |= {s: float(limit * sizes[s]) for s in full}
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in targets]
    return targets


@dataclass
class _Flow:
    """Min-cost maximum flow by shortest augmenting paths with potentials."""

    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y), self.room.append(r), self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = dict.fromkeys(self.out, 0)
        while True:
            dist, via, queue = {source: 0}, {}, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for e in self.out.get(a, ()):
                    b = self.to[e]
                    if self.room[e] and (n := d + self.cost[e] + height[a] - height[b]) < dist.get(b, 1 << 62):
                        dist[b], via[b] = n, e
                        heapq.heappush(queue, (n, b))
            if sink not in dist:
                return
            far = max(dist.values())
            for v in height:
                height[v] += dist.get(v, far)
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(
    patterns: dict[tuple, int], targets: dict[str | None, float], costs: Sequence[int] = REPEAT_COSTS
) -> dict[tuple, int]:
    """Words to take from every pattern (its sources → its size), repeats
    counted, so that the sources' quotas are met as far as they can be, at the
    least cost of repetition."""
    net, names, sources = _Flow(), sorted(patterns, key=repr), list(targets)
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    taps = {}
    for i, p in enumerate(names):
        taps[p] = [net.edge(0, 2 + i, patterns[p], c) for c in costs]
        for s in p:
            net.edge(2 + i, at[s], patterns[p] * len(costs), 0)
    for s in sources:
        net.edge(at[s], 1, int(targets[s]), 0)
    if names:
        net.run(0, 1)
    return {p: sum(net.room[e ^ 1] for e in taps[p]) for p in names}


def _plan_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "_pattern string, _whole long, _rest long, _cut long, _left long")


def _measured(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """`_doc` (the input row as a struct), _key, _size, _members, _pattern, and the
    place in the seeded order: _hash, of which _place is the beginning."""
    many = docs.schema[source].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.coalesce(F.col(source), F.array(F.lit(None).cast("string"))))) if many \
        else F.array(F.col(source))
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_key"),
        count_words(F.col(text)).alias("_size"), members.alias("_members"),
        F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"}).alias("_pattern"),
        # Flipping the sign makes the order of longs that of the bits.
        hashed.bitwiseXOR(F.lit(-(1 << 63))).alias("_hash"),
        F.shiftrightunsigned(hashed, 64 - _LEVEL_BITS * _LEVELS).alias("_place"),
    )


def _plan(kept: DataFrame, weights: Sequence[float], limit: int, max_patterns: int) -> DataFrame:
    """Per pattern: whole takings of its documents, the last place of the order
    that gets one more, and source_size and target (sums over its sources)."""
    spark = kept.sparkSession
    if len(REPEAT_COSTS) < limit:
        raise ValueError("a repetition cost is needed for every repetition")
    found = kept.groupBy("_pattern").agg(F.sum("_size").alias("n"), F.first("_members").alias("m")) \
        .limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["m"]): int(r["n"]) for r in found}
    name = {tuple(r["m"]): r["_pattern"] for r in found}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_for(sizes, weights, limit)
    flow = route(patterns, targets, REPEAT_COSTS[:limit])

    # pattern → [whole takings, words still to take, beginning of the cut, words left there]
    plan = {name[p]: [f // patterns[p], f % patterns[p], 0, f % patterns[p]] if patterns[p] else [0, 0, 0, 0]
            for p, f in flow.items()}

    def open_() -> DataFrame:
        return F.broadcast(spark.createDataFrame([(k, v[2], v[3]) for k, v in plan.items() if v[1]],
                                                 "_pattern string, _cut long, _left long"))

    running = Window.partitionBy("_pattern").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(_LEVELS):
        shift = _LEVEL_BITS * (_LEVELS - 1 - level)
        inside = kept.join(open_(), "_pattern").where(F.shiftrightunsigned("_place", shift + _LEVEL_BITS) == F.col("_cut"))
        digit = F.shiftrightunsigned("_place", shift).bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1))
        digits = inside.groupBy("_pattern", "_left", digit.alias("_digit")).agg(F.sum("_size").alias("_n"))
        below = digits.withColumn("_below", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        best = below.where(F.col("_below") <= F.col("_left")).groupBy("_pattern").agg(
            F.max_by(F.struct("_digit", "_below"), "_digit").alias("b")).collect()
        for r in best:
            v = plan[r["_pattern"]]
            v[2] = (v[2] << _LEVEL_BITS) | int(r["b"]["_digit"])
            v[3] -= int(r["b"]["_below"])
    # The document at the cut itself is taken when more than half of it fits.
    at_cut = kept.join(open_(), "_pattern").where(F.col("_place") == F.col("_cut"))
    sums = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = at_cut.withColumn("_fits", 2 * sums - F.col("_size") <= 2 * F.col("_left")).where("_fits").groupBy("_pattern") \
        .agg(F.max("_hash").alias("h")).collect()
    ends = {k: (v[2] << (64 - _LEVEL_BITS * _LEVELS)) - (1 << 63) - 1 for k, v in plan.items() if v[1]}
    ends |= {r["_pattern"]: r["h"] for r in last}
    rows = [(name[p], plan[name[p]][0], max(ends.get(name[p], -(1 << 63)), -(1 << 63)), name[p] in ends,
             sum(sizes[s] for s in p), float(sum(targets[s] for s in p))) for p in patterns]
    return F.broadcast(spark.createDataFrame(
        rows, "_pattern string, _whole long, _end long, _more boolean, source_size long, target double"))


def _times():
    return F.col("_whole") + (F.col("_more") & (F.col("_hash") <= F.col("_end"))).cast("long")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0), limit: int = 3, seed: int = 11, max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """One row per input row: key, size (words), source_size, target, taken.

    `source` is a string column (one source a document) or an array of strings
    (several); with several, source_size and target are sums over them.
    `taken` is a multiple of `size` up to `limit`.
    """
    kept = written(_measured(docs, key, text, source, seed).drop("_doc"), "mix-sizes")
    return kept.join(_plan(kept, weights, limit, max_patterns), "_pattern").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * _times()).alias("taken"))


def take(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0), limit: int = 3, seed: int = 11, max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """The mix itself: every input row as often as `mix` takes it. Texts are read
    twice and not shuffled."""
    rows = _measured(docs, key, text, source, seed)
    plan = _plan(written(rows.drop("_doc"), "mix-sizes"), weights, limit, max_patterns)
    times = F.when(F.col("_size") > 0, _times()).otherwise(0).cast("int")
    return rows.join(plan, "_pattern").withColumn("_again", F.explode(F.array_repeat(F.lit(0), times))).select("_doc.*")
