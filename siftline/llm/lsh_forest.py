"""Near-duplicates by an LSH forest, with every link confirmed on full sets.

A document's set are its distinct 5-word shingles (A-Z lower-cased; fewer words:
the whole sequence). Equal sets are one node, named by their smallest key. Nodes
get `HASHES` minimum hashes; each of `trees_for` trees orders them by some of these.

* Regions: nodes that share the first `DEPTH` values of a tree, which is where its
  order has neighbours of a long common prefix. Two sets at the threshold share no
  region of any tree in one case of a million (`missed`; all trees draw from the same
  hashes, so this is a mean over how many of these agree).
* Adaptive depth: regions of more than `DENSE` nodes are joined whole, first those of
  two trees, then the others' with what has come together as one node. So a group of
  copies costs a row per node in the first trees and hardly any in the others.
* In other regions nodes are compared by their hashes' low bytes, within the task;
  again first in some trees, and then only in regions that still hold two families.
  Pairs that may reach the threshold (about one in a million that do is below
  `agreeing`) are not emitted, only each node's head among those they tie it to.
* Families, the components of these ties, are confirmed on full sets (`families`).

Nothing is capped: every pair that shares a region is compared or in one family. Texts
without words are linked with nothing, nor are rows without a key; rows that share a
key are one document. `near_duplicates` keeps repeated rows, `keep_one` does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import families
from siftline.llm.common import arrow_map, written
from siftline.llm.graph import components
from siftline.llm.screen import asked_texts, may_be_among
from siftline.llm.words import mixed, runs, shingles, words_of

WORDS, HASHES, MOST_TREES, DEPTH, MISSED = 5, 128, 128, 5, 1e-6
DENSE, FIRST_DENSE, FIRST_TREES = 512, 2, 4

_random = np.random.Generator(np.random.PCG64(8))
_FACTOR = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_TERM = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PATHS = np.stack([_random.permutation(HASHES)[:DEPTH] for _ in range(MOST_TREES)])


def missed(percent: int, trees: int) -> float:
    """How often sets of that similarity share no region: a mean over the number of
    agreeing hashes, as all trees draw theirs from the same ones."""
    p = percent / 100
    return sum(comb(HASHES, x) * p ** x * (1 - p) ** (HASHES - x) * (1 - comb(x, DEPTH) / comb(HASHES, DEPTH)) ** trees for x in range(HASHES + 1))


def trees_for(percent: int) -> int:
    """So many trees that `missed` is at most one in a million (36 for 85 %, 57 for 80 %)."""
    for n in range(1, MOST_TREES + 1):
        if missed(percent, n) <= MISSED:
            return n
    raise ValueError("the similarity is too low for this forest")


def agreeing(percent: int) -> int:
    """Of HASHES low bytes, at least so many agree for sets of that similarity, but
    for about 1 case in a million (90 for 85 %, 81 for 80 %)."""
    p = percent / 100
    return int(HASHES * p - 4.65 * np.sqrt(HASHES * p * (1 - p)))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Every text's set, as sorted 64-bit hashes."""
    for _, some in runs([(t or "").encode().lower() for t in texts]):
        words = words_of(some)
        for a, b in pairwise(words.first):
            yield np.unique(shingles(words.hashes[a:b], WORDS))


def _signature(hashes: np.ndarray) -> np.ndarray:
    x, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at: at + 1024, None] * _FACTOR + _TERM).min(axis=0), out=out)
    return out


def _sketches(docs: DataFrame, kind: str, n_trees: int) -> DataFrame:
    """key, n_shingles, digest of the set, low bytes of the signature, and the region
    in every tree."""
    trees, paths = np.arange(n_trees, dtype=np.uint64), _PATHS[:n_trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, low, regions = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    low.append(None), regions.append(None)
                    continue
                values = _signature(s)
                key = trees
                for i in range(DEPTH):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[paths[:, i]])
                low.append(values.astype(np.uint8).tobytes())
                regions.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()),
                 pa.array(regions, pa.list_(pa.int64()))], ["key", "n_shingles", "digest", "low", "regions"])

    return arrow_map(docs, run, f"key {kind}, n_shingles long, digest binary, low binary, regions array<long>")


def _heads(ties: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of ties the first row of its component."""
    head = np.arange(len(ties))
    while True:
        least = np.where(ties, head[None, :], len(ties)).min(axis=1, initial=len(ties))
        least = np.minimum(head, least)
        least = least[least]
        if (least == head).all():
            return head
        head = least


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), np.int16)
    for at in range(0, len(a), 16):
        out[at: at + 16] = (a[at: at + 16, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
    return out


def _tie_regions(members: DataFrame, kind: str, least: int) -> DataFrame:
    """Ties (a, b) inside every region (region, node, low): a node and the first node
    of those that may be similar, over chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            node_type = batch.schema.types[0].value_type.field("node").type
            for nodes in batch.column(0).to_pylist():
                nodes.sort(key=lambda x: x["node"])
                names = [x["node"] for x in nodes]
                bytes_ = np.frombuffer(b"".join(x["low"] for x in nodes), np.uint8).reshape(-1, HASHES)
                for i, h in enumerate(_heads(_agreement(bytes_, bytes_) >= least)):
                    if h != i:
                        a.append(names[h]), b.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, node_type), pa.array(b, node_type)], ["a", "b"])

    grouped = members.groupBy("region").agg(F.collect_list(F.struct("node", "low")).alias("nodes")).select("nodes")
    return arrow_map(grouped, run, f"a {kind}, b {kind}", rows=64)


def _candidate_families(nodes: DataFrame, kind: str, percent: int) -> DataFrame:
    """(node, comp) of nodes (node, low, regions) that ties bring together."""
    n_trees = trees_for(percent)
    ties, family = None, None

    def more(found: DataFrame, name: str) -> None:
        nonlocal ties, family
        found = written(found, name)
        if not found.isEmpty():
            ties = found if ties is None else ties.unionByName(found)
            family = components(ties)

    def places(first: int, end: int) -> DataFrame:
        """(node, fam, region) in the trees from `first` to before `end`."""
        held = nodes.select("node", "regions")
        if family is not None:
            held = held.join(family.withColumnRenamed("comp", "fam"), "node", "left")
        fam = F.coalesce("fam", "node") if family is not None else F.col("node")
        return held.select("node", fam.alias("fam"), F.explode(F.slice("regions", first + 1, end - first)).alias("region"))

    def open_regions(rows: DataFrame) -> DataFrame:
        """Regions of two families or more: size, first (the smallest family)."""
        return rows.groupBy("region").agg(
            F.count(F.lit(1)).alias("size"), F.min("fam").alias("first"), F.max("fam").alias("last")).where("first < last").drop("last")

    for trees in ((0, FIRST_DENSE), (FIRST_DENSE, n_trees)):
        rows = places(*trees)
        dense = written(open_regions(rows).where(F.col("size") > DENSE), "dense-regions")
        if not dense.isEmpty():
            held = rows.select("region", "fam").distinct().join(dense, "region").where("fam <> first")
            more(held.select(F.col("first").alias("a"), F.col("fam").alias("b")).distinct(), "dense-ties")
    for trees in ((0, FIRST_TREES), (FIRST_TREES, n_trees)):
        rows = places(*trees)
        sparse = written(open_regions(rows).where(F.col("size") <= DENSE).select("region"), "sparse-regions")
        members = rows.select("node", "region").join(sparse, "region").join(nodes.select("node", "low"), "node")
        more(_tie_regions(members, kind, agreeing(percent)), "sparse-ties")
    return nodes.select("node", F.col("node").alias("comp")).limit(0) if family is None else family


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key
    that links reach; its own where there are none, null without a key), kept
    (the key is the component's, or there is no key)."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    sketches = written(_sketches(picked, kind, trees_for(percent)), "sketches")
    with_set = sketches.where("key is not null and n_shingles > 0")
    nodes = written(with_set.groupBy("digest").agg(
        F.min("key").alias("node"), F.max(F.struct("low", "n_shingles", "regions")).alias("made")).select(
        "digest", "node", F.col("made.low").alias("low"), F.col("made.n_shingles").alias("n"), F.col("made.regions").alias("regions")), "nodes")
    family = _candidate_families(nodes, kind, percent)
    placed = written(families.chunked(family.join(nodes.select("node", "n"), "node")).select("comp", "node", "chunks"), "placed")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for s in shingle_sets(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["comp", "node", "chunks", "shingles"])

    some = asked_texts(picked, placed.select(F.col("node").alias("key"))).withColumnRenamed("key", "node")
    texts = placed.join(some, "node").select("comp", "node", "chunks", "text")
    sets = written(arrow_map(texts, full, f"comp {kind}, node {kind}, chunks int, shingles binary", rows=64), "sets")
    linked = families.linked(sets.where(F.length("shingles") > 0), kind, percent)

    of_set = nodes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    some = with_set.select("key", "n_shingles", "digest").join(of_set, "digest").select("key", "n_shingles", F.col("comp").alias("component_id"))
    rest = sketches.where("key is null or n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return some.unionByName(rest).select(
        F.col("key").alias(key), "n_shingles", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One input row of every component: the smallest key's; of several rows of that
    key one with the least digest of its text. Of the rows without a key one of each
    text stays, unless a row with a key has that text."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), digest.alias("digest"))
    told = written(near_duplicates(docs, key, text, percent).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")), "told")
    first = F.min_by("row", "digest").alias("row")
    # What goes is less than what stays; texts that surely stay are not shuffled for it.
    odd = told.where("not kept or n > 1").select("id")
    maybe = may_be_among(F.col("id"), odd)
    asked = rows.where(maybe)
    out = rows.where(F.col("id").isNotNull() & ~maybe).select("row").unionByName(asked.join(odd, "id", "left_anti").select("row"))
    repeated = told.where("kept and n > 1").select("id")
    if not repeated.isEmpty():
        out = out.unionByName(asked.join(repeated, "id", "left_semi").groupBy("id").agg(first).select("row"))
    lone = rows.where("id is null")
    if not lone.isEmpty():
        known = rows.where("id is not null").select("digest")
        out = out.unionByName(lone.groupBy("digest").agg(first).join(known, "digest", "left_anti").select("row"))
    return out.select("row.*")
