"""Approximate nearest neighbours by balanced posting lists.

Vectors are put into lists around centroids; a vector near a border stands in
several lists. A query looks at the lists of all centroids that are not much
farther than its nearest one (by a ratio of distances), found by a walk through an
in-memory graph of the centroids, and takes the best of those lists' vectors.

* Centroids are fitted by balanced splitting on a sample of at most `FIT_ROWS`
  vectors and `FIT_BYTES`: a cluster is cut in two, by its farthest members, until it holds its
  share. There are at most `MAX_LISTS` of them, so what is broadcast is bounded;
  beyond that lists grow, and are kept in blocks.
* Every vector is indexed. Equal vectors are one entry with their smallest ids (as
  many as a result can hold), so copies do not swell a list.
* Lists and queries are packed into blocks of bounded size and meet in an equi join
  on the list; a task multiplies one block of each. No task holds a list.

Nearness is the inner product. Lists are built in the space of one more coordinate,
sqrt(longest^2 - |v|^2) (0 for a query), where the order of distances is that of
inner products. Scores are made in double precision from the original vectors.

Vectors that are null, zero, of another dimension than most, or that hold null or
non-finite components take no part, neither as query nor as candidate, nor do rows
without an id. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import arrow_map, written

FIT_ROWS, FIT_BYTES, MAX_LISTS, PER_LIST, BLOCK = 65_536, 1 << 26, 16_384, 512, 512
#: A list is looked at up to this ratio of its centroid's distance to the nearest
#: one's; a vector stands in lists up to the other ratio, `COPIES` at most.
SEARCH_RATIO, BORDER_RATIO, COPIES = 1.1, 1.04, 4
#: A query looks at the nearest lists of so many times k vectors in any case.
LOOKED = 64
_DEGREE, _ENTRIES, _STEPS = 24, 4, 8
#: Distances that a walk of many rows keeps.
_WALKED = 1 << 20
#: Rows a task holds, and as from how many it cuts them back; candidates beyond k + 1
#: that near-ties may need.
_HELD, _CUT, _SPARE = 1 << 18, 1 << 15, 4


def _balanced(x: np.ndarray, n: int, random: np.random.Generator) -> np.ndarray:
    """`n` centroids of clusters of nearly equal size."""
    open_, done = [(np.arange(len(x)), n)], []
    while open_:
        rows, parts = open_.pop()
        if parts <= 1 or len(rows) < 2:
            done.append(x[rows].mean(axis=0))
            continue
        own = x[rows]
        a = own[np.argmax(((own - own[random.integers(len(own))]) ** 2).sum(axis=1))]
        b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
        left = parts // 2
        cut = len(rows) * left // parts
        for _ in range(4):
            order = np.argsort(((own - a) ** 2).sum(axis=1) - ((own - b) ** 2).sum(axis=1), kind="stable")
            a, b = own[order[:cut]].mean(axis=0), own[order[cut:]].mean(axis=0)
        open_ += [(rows[order[:cut]], left), (rows[order[cut:]], parts - left)]
    return np.stack(done)


class CentroidGraph:
    """Centroids, each with links to its nearest and to some random others."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.centroids, random = centroids, np.random.default_rng(seed)
        n = len(centroids)
        near = min(_DEGREE, n - 1)
        links: list[set[int]] = [set() for _ in range(n)]
        squares = (centroids ** 2).sum(axis=1)
        for at in range(0, n, 512):
            d = squares - 2 * centroids[at: at + 512] @ centroids.T
            for i, row in enumerate(d, at):
                row[i] = np.inf
                for j in np.argpartition(row, near - 1)[:near].tolist() if near else ():
                    links[i].add(j), links[j].add(i)
                links[i].update(random.integers(0, n, 4).tolist())
        self.links = [np.fromiter(s, np.int64) for s in links]
        self.degree = np.fromiter(map(len, self.links), np.int64, n)
        # Centroids come in the order of the splits, so these lie all over; their number
        # follows the root of all, and a walk is not caught in a cluster.
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16 + _ENTRIES * int(np.sqrt(n)))).astype(np.int64))

    def within(self, v: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """`within_all` for one vector: centroids and distances."""
        return self.within_all(v[None, :], ratio, least)[1:]

    def within_all(self, vs: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of `vs`, and centroids whose distance to a row is at most `ratio` times
        the nearest one's, and the `least` nearest, nearest first, and the distances: a
        best-first walk for each row that ends when its nearest open centroid is clearly
        beyond that bound. Many rows walk side by side, a step of all at once."""
        size = max(1, _WALKED // len(self.centroids))
        parts = [self._walk(vs[at: at + size], ratio, least) for at in range(0, len(vs), size)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows = np.concatenate([p[0] + i * size for i, p in enumerate(parts)])
        return rows, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def _walk(self, vs: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.centroids)
        seen = np.full((len(vs), n), np.inf)
        open_, best = seen.copy(), np.full(len(vs), np.inf)

        def look(row: np.ndarray, new: np.ndarray) -> None:
            for at in range(0, len(row), 1 << 14):
                r, c = row[at: at + (1 << 14)], new[at: at + (1 << 14)]
                d = np.sqrt(((self.centroids[c] - vs[r]) ** 2).sum(axis=1))
                seen[r, c] = open_[r, c] = d
                np.minimum.at(best, r, d)

        walking = np.arange(len(vs))
        look(np.repeat(walking, len(self.entries)), np.tile(self.entries, len(vs)))
        known, steps = np.full(len(vs), len(self.entries)), 0
        while True:
            walking = walking[known[walking] < n]
            some = open_[walking]
            c = some.argmin(axis=1)
            d = some[np.arange(len(c)), c]
            on = np.isfinite(d) & ((d <= ratio * best[walking]) | (steps < max(_STEPS, least)))
            walking, c = walking[on], c[on]
            if not len(walking):
                break
            steps += 1
            open_[walking, c] = np.inf
            row, new = np.repeat(walking, self.degree[c]), np.concatenate([self.links[i] for i in c.tolist()])
            unseen = np.isinf(seen[row, new])
            look(row[unseen], new[unseen])
            known += np.bincount(row[unseen], minlength=len(vs))
        bound = ratio * best + 1e-12
        if least > 1:
            bound = np.maximum(bound, np.partition(seen, least - 1, axis=1)[:, least - 1] if least < n else np.inf)
        row, c = np.nonzero((seen <= bound[:, None]) & np.isfinite(seen))
        d = seen[row, c]
        order = np.lexsort((c, d, row))
        return row[order], c[order], d[order]


def _usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame, is_query: Column, id_: str = "vec_id", vector: str = "embedding", k: int = 20,
    search_ratio: float = SEARCH_RATIO, per_list: int = PER_LIST,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` nearest found for every
    row that meets `is_query`, among all rows but itself."""
    spark = vectors.sparkSession
    picked = vectors.where(F.col(id_).isNotNull() & _usable(F.col(vector))).select(
        F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    common = picked.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), b.column(2),
                 pa.array((rows ** 2).sum(axis=1))], ["id", "v", "asks", "square"])

    flat = arrow_map(picked.where(F.size("v") == dim), packed, "id long, v binary, asks boolean, square double", rows=4096)
    # A vector with its smallest ids: a result holds k, and the query's own is left out.
    ids = flat.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(
        F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("square").alias("square"))
    entries = written(ids.groupBy("v").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"),
        F.max("square").alias("square")).withColumn("entry", F.col("ids")[0]), "ann-entries")
    asked = flat.where("asks").select("id", "v")

    total, longest = entries.agg(F.count(F.lit(1)), F.max("square")).first()
    fit_rows = max(1, min(FIT_ROWS, FIT_BYTES // (8 * dim)))
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(fit_rows).select("v", "square").toArrow()
    raw = _matrix(sample.column(0).combine_chunks(), dim)
    longest = float(longest)
    lifted = np.column_stack([raw, np.sqrt(np.maximum(0, longest - np.asarray(sample.column(1))))])
    n_lists = int(min(MAX_LISTS, max(1, -(-total // per_list)), max(1, len(raw) // 4)))
    graph = spark.sparkContext.broadcast(CentroidGraph(_balanced(lifted, n_lists, np.random.default_rng(3))))

    def lists(ratio: float, most: int | None, is_entry: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column(1), dim)
                last = np.sqrt(np.maximum(0.0, longest - (v ** 2).sum(axis=1))) if is_entry else np.zeros(len(v))
                which, place, _ = graph.value.within_all(np.column_stack([v, last]), ratio, 1 if is_entry else -(-LOOKED * k // per_list))
                if most is not None:
                    first = np.arange(len(which)) - np.searchsorted(which, which) < most
                    which, place = which[first], place[first]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(which)) for c in b.columns), pa.array(place)], [*b.schema.names, "list"])
        return run

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """Rows of a list in blocks of about BLOCK, two columns: names and vectors."""
        held = written(df, name)
        sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
        return held.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("name"), "n_blocks").alias("block")).agg(
            F.collect_list(F.struct("name", "v", "ids")).alias(name)).select("list", name)

    plain = entries.select(F.col("entry").alias("name"), "v", "ids")
    filled = blocks(arrow_map(plain, lists(BORDER_RATIO, COPIES, True), "name long, v binary, ids array<long>, list long"), "held")
    # Equal queries are searched once.
    questions = asked.select("v").distinct().select(F.xxhash64("v").alias("name"), "v", F.array().cast("array<long>").alias("ids"))
    asking = blocks(arrow_map(questions, lists(search_ratio, None, False), "name long, v binary, ids array<long>, list long"), "asking")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every question's k + 1 best entries of a task's block pairs, with their ids.
        What is held is cut back to that whenever it has doubled; then a question's last
        is the floor that its further candidates must reach."""
        names, vectors_, ids_of, floor, most = {}, [], {}, np.zeros(0), _CUT
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

        def cut_back() -> list[np.ndarray]:
            q, s, e = held
            order = np.lexsort((e, q))
            q, s, e = q[order], s[order], e[order]
            once = np.append(True, (q[1:] != q[:-1]) | (e[1:] != e[:-1]))[: len(q)]
            q, s, e = q[once], s[once], e[once]
            order = np.lexsort((e, -s, q))
            q, s, e = q[order], s[order], e[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            floor[q[place == k + _SPARE]] = s[place == k + _SPARE]
            return [x[place <= k + _SPARE] for x in (q, s, e)]

        def out() -> pa.RecordBatch:
            q, s, e = cut_back()
            # Scores from the vectors in one order of summing: the same in every task.
            for at in range(0, len(q), 8192):
                a = np.frombuffer(b"".join(vectors_[i] for i in q[at: at + 8192].tolist()), np.float64).reshape(-1, dim)
                b = np.frombuffer(b"".join(ids_of[i][1] for i in e[at: at + 8192].tolist()), np.float64).reshape(-1, dim)
                s[at: at + 8192] = (a * b).sum(axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([vectors_[i] for i in q.tolist()], pa.binary()), pa.array([ids_of[i][0] for i in e.tolist()], pa.list_(pa.int64())),
                 pa.array(s, pa.float64())], ["v", "ids", "score"])

        for b in batches:
            for q, e in zip(b.column(0), b.column(1), strict=True):
                q, e = q.values, e.values
                scores = _matrix(q.field("v"), dim) @ _matrix(e.field("v"), dim).T
                first = np.asarray(e.field("name"))
                asks = []
                for v in q.field("v").to_pylist():
                    if v not in names:
                        names[v] = len(vectors_)
                        vectors_.append(v)
                    asks.append(names[v])
                floor = np.append(floor, np.full(len(names) - len(floor), -np.inf))
                least = floor[asks]
                if scores.shape[1] > k + 1 and np.count_nonzero(scores >= least[:, None]) > (k + 1) * len(asks):
                    place = scores.shape[1] - k - 1
                    least = np.maximum(least, np.partition(scores, place, axis=1)[:, place])
                # Ties at the border stay, for the smaller id to win.
                row, col = np.nonzero(scores >= (least - 1e-12 * np.abs(least))[:, None])
                if not len(row):
                    continue
                used = np.unique(col)
                some = pa.array(used)
                ids_of.update(zip(first[used].tolist(), zip(
                    e.field("ids").take(some).to_pylist(), e.field("v").take(some).to_pylist(), strict=True), strict=True))
                held = [np.concatenate([h, x]) for h, x in zip(held, (np.asarray(asks)[row], scores[row, col], first[col]), strict=True)]
                if len(held[0]) > most:
                    held = cut_back()
                    ids_of = {i: ids_of[i] for i in set(held[2].tolist())}
                    most = max(_CUT, 2 * len(held[0]))
                    if len(held[0]) > _HELD // 2:
                        yield out()
                        names, vectors_, ids_of, floor, most = {}, [], {}, np.zeros(0), _CUT
                        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        yield out()

    found = arrow_map(asking.join(filled, "list").select("asking", "held"), multiply, "v binary, ids array<long>, score double", rows=4)
    # An entry found in several lists counts once; k + 1 entries hold at least k other ids.
    best = found.groupBy("v").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "ids"))), 1, k + 1).alias("found"))
    answers = best.join(asked, "v").select("id", F.slice(F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(
        F.filter(f["ids"], lambda i: i != F.col("id")), lambda i: F.struct(f["minus"].alias("minus"), i.alias("vec_id")))))), 1, k).alias("top"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("top").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.minus")).alias("score"))
