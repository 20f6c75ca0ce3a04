"""N-gram Jaccard join by a token-group matrix.

A document's set are its distinct shingles (A-Z lower-cased; fewer words: the whole
sequence). Equal sets are one node.

* Groups: nodes of the same `LOWEST` smallest shingle hashes (similar sets share them
  more often than not, others hardly ever, where a single one would bring together any
  two sets with a common passage), in pieces of `GROUP` nodes. Members of a group are a
  family from the start.
* Matrix: tokens are ordered by how common their cell of a small count table is, then
  by hash, so that a shared passage comes last. Two sets at the threshold share one of
  their first n - ceil(t n) + 1 tokens. The matrix holds, for each such token, the
  groups with a member that has it, and the sizes of these members; a row that only one
  group has is dropped.
* Bound: groups that meet in the matrix are compared through the unions of their
  members' smallest hashes: a token of a query that the other group's union lacks is
  lacking in all its members. A group is opened for another only if they share enough
  rows of the matrix and some query's bound reaches the threshold; both are one family
  then.
* Rows of the matrix that many groups share are first walked along, in two orders, and
  neighbours that keep meeting are compared; what comes together needs no more pairs.
  Then each of these rows pairs the groups outside its largest family with all others,
  and a row of few groups pairs all of them. So groups of copies give rows linear in
  their size.
* Families are verified on full sets (`families`): the result is exact, but for
  collisions of 64-bit hashes.

Counts steer the order alone, never what is found. Texts without words are linked with
nothing, nor are rows without a key. Repeated rows are kept, each with its key's
component; rows that share a key but not a text have a set each. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import families
from siftline.llm.common import arrow_map, written
from siftline.llm.graph import components
from siftline.llm.screen import asked_texts, bitmap, marked, may_be_among
from siftline.llm.words import mixed, runs, shingles, words_of

WORDS, PERCENT = 4, 85
LOWEST, GROUP, GROUP_TOKENS, WALKED = 2, 64, 1 << 20, 16
CELL_BITS, _BLOCKS = 20, 16
SIDE = "g", "fam", "low", "high"


def _sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Every text's set, as sorted 64-bit hashes."""
    for _, some in runs([(t or "").encode().lower() for t in texts]):
        found = words_of(some)
        for a, b in pairwise(found.first):
            yield np.unique(shingles(found.hashes[a:b], words))


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _least(s: np.ndarray) -> int | None:
    """One number for the smallest hashes of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(s[:LOWEST].tobytes()), "big", signed=True) if len(s) else None


def _packed(counts: np.ndarray) -> bytes:
    """Counts by their bytes' places, as most are small."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(held), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _needed(n: np.ndarray | int, percent: int):
    """So many tokens of a set of n are in any set at the threshold."""
    return -(-percent * n // 100)


def _sized(picked: DataFrame, kind: str, words: int) -> DataFrame:
    """Per document: key, n, digest, least (of its smallest hashes); and per task the counts of its
    tokens by cell, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key_type = np.zeros(1 << CELL_BITS, np.int64), None
        for batch in batches:
            n, digests, least, key_type = [], [], [], batch.schema.types[0]
            for s in _sets(batch.column(1).to_pylist(), words):
                n.append(len(s)), digests.append(_digest(s)), least.append(_least(s))
                np.add.at(counts, _cells(s), 1)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.int64()), *none], names)
        if key_type is not None:
            blocks = [(i, _packed(b)) for i, b in enumerate(counts.reshape(_BLOCKS, -1)) if b.any()]
            m = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, key_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                 pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names)

    names = ["key", "n", "digest", "least", "block", "counts"]
    return arrow_map(picked, run, f"key {kind}, n long, digest binary, least long, block int, counts binary")


def _weights(sized: DataFrame) -> np.ndarray:
    """Of every cell, how often its count doubles the mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"block": at, "counts": total.tobytes()}], kind)
                    at, total = block, np.zeros((1 << CELL_BITS) // _BLOCKS, np.int64)
                total += _unpacked(counts)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"block": at, "counts": total.tobytes()}], kind)

    kind = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    parts = sized.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    whole = np.zeros((_BLOCKS, (1 << CELL_BITS) // _BLOCKS), np.int64)
    for r in arrow_map(parts, add, "block int, counts binary", rows=4).collect():  # 16 blocks of 512 KB
        whole[r["block"]] = np.frombuffer(r["counts"], np.int64)
    whole = whole.reshape(-1)
    return np.log2(np.maximum(whole / max(whole.mean(), 1), 1)).astype(np.uint8)


def _marks(picked: DataFrame, kind: str, weights, words: int, percent: int) -> DataFrame:
    """Per document with words: key, digest, least, n, prefix (its first tokens in the
    matrix' order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, s in enumerate(_sets(batch.column(1).to_pylist(), words)):
                if not len(s):
                    continue
                first = len(s) - int(_needed(len(s), percent)) + 1
                order = np.lexsort((mixed(s), weights.value[_cells(s)]))[:first]
                at.append(i), out.append((_digest(s), _least(s), len(s), s[order].view(np.int64).tolist()))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))],
                    ["key", "digest", "least", "n", "prefix"])

    return arrow_map(picked, run, f"key {kind}, digest binary, least long, n long, prefix array<long>")


def _probes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Per text with words: digest, least, n, probe (its smallest hashes, in 32 bits),
    reach (below it the probe is complete)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in _sets(batch.column(0).to_pylist(), words):
                if not len(s):
                    continue
                short, most = (s >> np.uint64(32)).astype("<u4"), min(len(s), 2 * (len(s) - int(_needed(len(s), percent)) + 1))
                out.append((_digest(s), _least(s), len(s), short[:most].tobytes(), int(short[most - 1]) if most < len(s) else 1 << 32))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["digest", "least", "n", "probe", "reach"])

    return arrow_map(texts, run, "digest binary, least long, n long, probe binary, reach long")


def _qualified(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups of which one is to be opened for the other."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["g"], np.unique(np.concatenate([np.frombuffer(m["probe"], "<u4") for m in r["members"]])).tobytes(), min(m["n"] for m in r["members"]),
                    max(m["n"] for m in r["members"]), min(m["reach"] for m in r["members"])) for r in batch.to_pylist()]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["g", "union", "low", "high", "reach"])

    def bound(queries: list[dict], other: dict) -> bool:
        union, low, high, reach = np.frombuffer(other["union"], "<u4"), other["low"], other["high"], other["reach"]
        for q in queries:
            least = max(low, int(_needed(q["n"], percent)))
            if least > min(high, 100 * q["n"] // percent):
                continue
            known = np.frombuffer(q["probe"], "<u4")
            known = known[known < min(reach, q["reach"])]
            lacking = len(known) - int((union[np.minimum(np.searchsorted(union, known), len(union) - 1)] == known).sum())
            # An overlap of both * (100 + t) >= t * (sum of sizes) is needed.
            if lacking <= q["n"] + (-percent * (q["n"] + least)) // (100 + percent):
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["a"], r["b"]) for r in batch.to_pylist() if bound(r["x"], r["y"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    groups = written(groups.withColumn("size", F.size("members")), "groups")
    # Links show from either side: the smaller group's members go to the larger's union.
    sizes = groups.select(F.col("g"), "size")
    first = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    turned = F.col("size_a") > F.col("size_b")
    pairs = first.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    pairs = written(pairs, "turned-pairs")
    # Most groups are on one side only.
    unions = arrow_map(groups.where(may_be_among(F.col("g"), pairs.select("b"))), united, "g long, union binary, low long, high long, reach long", rows=64)
    queries = groups.where(may_be_among(F.col("g"), pairs.select("a"))).select(F.col("g").alias("a"), F.col("members").alias("x"))
    others = unions.select(F.col("g").alias("b"), F.struct("union", "low", "high", "reach").alias("y"))
    return arrow_map(pairs.join(queries, "a").join(others, "b"), run, "a long, b long", rows=64)


def _fits(a: str, b: str, percent: int):
    return (F.col(f"{a}.high") * 100 >= F.col(f"{b}.low") * percent) & (F.col(f"{b}.high") * 100 >= F.col(f"{a}.low") * percent)


def _with_family(matrix: DataFrame, family: DataFrame | None) -> DataFrame:
    if family is None:
        return matrix.withColumn("fam", F.col("g"))
    return matrix.join(family.select(F.col("node").alias("g"), F.col("comp").alias("fam")), "g", "left").withColumn("fam", F.coalesce("fam", "g"))


def _walk(matrix: DataFrame, family: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Neighbours of different families in the rows that many groups share; a row is
    walked in slices, which are the same ones in rows of about the same size. Groups
    that link are neighbours in most rows that they share; others meet here and there,
    and are left to `_rest`."""
    place = F.xxhash64(F.lit(turn), "g")
    slices = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("groups") / 512)))).cast("long")
    rows = _with_family(matrix, family).withColumn("slice", F.pmod(place, slices))
    ahead = Window.partitionBy("token", "slice").orderBy(place)
    found = rows.select(F.struct(*SIDE).alias("a"), F.lead(F.struct(*SIDE)).over(ahead).alias("b"))
    return _meeting(found, percent).where("rows * 2 >= least").select("a", "b")


def _rest(matrix: DataFrame, crowded: DataFrame | None, family: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of groups of different families that share rows enough of the matrix."""
    rows = _with_family(matrix, family)
    few = rows if crowded is None else rows.join(crowded.select("token"), "token", "left_anti")
    few = few.groupBy("token").agg(F.collect_list(F.struct(*SIDE)).alias("row")).where(F.size("row") > 1)  # WALKED at most
    each = F.transform("row", lambda x, i: F.transform(F.slice("row", i + 2, F.size("row")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    met = few.select(F.explode(F.flatten(each)).alias("pair")).select("pair.a", "pair.b")
    if crowded is not None:
        rows = rows.join(crowded.select("token"), "token")
        largest = rows.groupBy("token", "fam").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
            F.max(F.struct("c", "fam")).alias("top"), F.count(F.lit(1)).alias("fams")).where("fams > 1").select("token", F.col("top.fam").alias("top"))
        rows = written(rows.join(largest, "token").select("token", "top", F.struct(*SIDE).alias("a")), "open-rows")
        small = rows.where(F.col("a.fam") != F.col("top"))
        every = rows.select("token", F.col("a").alias("b"))
        met = met.unionByName(small.join(every, "token").where((F.col("b.fam") == F.col("top")) | (F.col("a.g") < F.col("b.g"))).select("a", "b"))
    return _meeting(met, percent).where("rows >= least").select("a", "b")


def _meeting(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups, of `met` (one row for each row of the matrix that they
    share): how many rows, and the least that a link needs for the sizes in any."""
    return met.where((F.col("a.fam") != F.col("b.fam")) & _fits("a", "b", percent)).groupBy(
        F.least("a.g", "b.g").alias("a"), F.greatest("a.g", "b.g").alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(_least_rows(percent)).alias("least"))


def _least_rows(percent: int):
    """So many rows of the matrix are shared by groups of which two sets link. Of two
    sets, that whose first tokens end earlier has its others behind all first tokens of
    the other: an overlap is at most the shared first tokens and the larger of the two
    rests. It is least for the most unequal sizes."""

    def of(one: str, other: str):
        large = F.col(f"{one}.high")
        small = F.greatest(F.col(f"{other}.low"), F.ceil(large * percent / 100))
        return F.ceil((large + small) * percent / (100 + percent)) - F.ceil(F.greatest(large, small) * percent / 100) + 1

    return F.least(of("a", "b"), of("b", "a"))


def _matrix(marks: DataFrame) -> DataFrame:
    """(token, g, low, high) of the tokens that several groups have, and of some others
    that the bitmap lets through."""
    shared = written(marks.select("g", F.explode("prefix").alias("token")).groupBy("token").agg(
        F.min("g").alias("first"), F.max("g").alias("last")).where("first < last").select("token"), "shared-tokens")
    bits = bitmap(shared)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            maybe = marked(bits.value, tokens)
            g, n = (np.repeat(batch.column(i).to_numpy(), lengths)[maybe] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[maybe]), pa.array(g), pa.array(n)], ["token", "g", "n"])

    rows = arrow_map(marks.select("g", "n", "prefix"), screened, "token long, g long, n long")
    return written(rows.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high")), "matrix")


def _families(marks: DataFrame, probes: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, comp): of every group that was opened for another, its family. `probes`
    gives those (g, n, probe, reach) of the members of groups (g)."""
    matrix, ties, family = _matrix(marks), None, None
    crowded = written(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > WALKED), "crowded-rows")
    crowded = None if crowded.isEmpty() else crowded
    for turn in (2,) if crowded is None else (0, 1, 2):
        pairs = written(_walk(matrix.join(crowded, "token"), family, turn, percent) if turn < 2
                        else _rest(matrix, crowded, family, percent), "group-pairs")
        asked = written(pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "asked-groups")
        groups = probes(asked).groupBy("g").agg(F.collect_set(F.struct("n", "probe", "reach")).alias("members"))
        found = written(_qualified(pairs, groups, percent), "ties")
        ties = found if ties is None else ties.unionByName(found)
        family = components(ties)
    return family


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key that
    links reach; its own where there are none; null without a key)."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    sized = written(_sized(picked, kind, words), "sized")
    rows = sized.where("block is null").drop("block", "counts")
    weights = picked.sparkSession.sparkContext.broadcast(_weights(sized))
    nodes = written(rows.where("key is not null and digest is not null").groupBy("digest").agg(
        F.min("key").alias("key"), F.max("n").alias("n"), F.max("least").alias("least")), "nodes")

    # Pieces of the groups of the same smallest hashes.
    pieces = written(nodes.groupBy("least").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select(
        "least", F.ceil(F.greatest(F.col("c") / GROUP, F.col("s") / GROUP_TOKENS)).alias("pieces")).where("pieces > 1"), "pieces")

    def grouped(df: DataFrame, *columns: str) -> DataFrame:
        piece = F.pmod(F.xxhash64("digest"), F.coalesce("pieces", F.lit(1)))
        return df.join(pieces, "least", "left").select(*columns, F.xxhash64("least", piece).alias("g"))

    marks = grouped(written(_marks(picked.where("key is not null"), kind, weights, words, percent), "marks"), "key", "n", "prefix")

    def probes(asked: DataFrame) -> DataFrame:
        some = picked.where(may_be_among(F.col("key"), marks.join(asked, "g", "left_semi").select("key")))
        return grouped(_probes(some.select("text"), words, percent), "n", "probe", "reach").join(asked, "g", "left_semi")

    family = _families(marks, probes, percent)

    nodes = grouped(nodes, "digest", "key", "n")
    placed = nodes.join(family.withColumnRenamed("node", "g"), "g", "left").select(
        F.coalesce("comp", "g").alias("comp"), F.col("digest").alias("node"), "key", "n")
    placed = written(families.chunked(placed).select("comp", "node", "key", "chunks"), "placed")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Another text of the same key is another node's.
            own = [_digest(s) == d for s, d in zip(_sets(batch.column(3).to_pylist(), words), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns, ["comp", "node", "chunks", "shingles"]).filter(pa.array(own, pa.bool_()))

    some = asked_texts(picked, placed.select("key"))
    texts = placed.join(some, "key").select("comp", "node", "chunks", "text")
    # Texts go to the families, which are about half as large as their sets.
    sets = written(arrow_map(texts, full, "comp long, node binary, chunks int, shingles string", rows=64), "sets")
    linked = written(families.linked(sets, "binary", percent, lambda held: list(_sets(held.to_pylist(), words))).join(nodes.select(F.col("digest").alias("node"), "key"), "node"), "linked")
    least = linked.groupBy("comp").agg(F.min("key").alias("component_id"))
    of_set = linked.join(least, "comp").select(F.col("node").alias("digest"), "component_id")
    of_node = nodes.join(of_set, "digest", "left").select("digest", F.coalesce("component_id", "key").alias("component_id"))
    some = rows.where("key is not null and digest is not null").join(of_node, "digest").select("key", "n", "component_id")
    rest = rows.where("key is null or digest is null").select("key", "n", F.col("key").alias("component_id"))
    return some.unionByName(rest).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
