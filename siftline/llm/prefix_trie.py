"""The trie of conversation prefixes, screened by a count-min sketch.

* Turns are numbered per conversation in a range-partitioned sort, so no task holds a
  long conversation; from then on a turn is 16 bytes (the digest of role and text)
  and a length, packed in runs of a bounded number of turns.
* The digest of a prefix is a sum over its (depth, turn) pairs in two 64-bit lanes, so
  a long conversation's runs are summed apart and then offset.
* A count-min sketch counts all prefix digests (counts above one are all alike). It
  never counts too little, so an estimate of one proves that a prefix, and with it
  every longer prefix of that conversation, belongs to one conversation: that tail's
  nodes are handed out at once. Only prefixes that may be shared are shuffled and
  grouped exactly. The sketch grows with the prefixes up to 3 x 2^25 cells (12 MB to
  every task); past that, more prefixes take the exact way and nothing else changes.
* Sums over subtrees: every node is counted at its smallest member; suffix sums along
  that conversation then reach all the node's ancestors, so there is no level-by-level
  iteration and hot nodes are summed before they are shuffled.
* The digest of a node's ends takes their ids in order. Ids are spelled out in
  blocks by range, and blocks stream through the hash; nothing is gathered.

Rows without a conversation id take no part. Turns are ordered by `turn`, null first,
ties by the digest of role and text; null role or text is empty; a repeated row is a
turn of its own. Other columns are ignored. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from siftline.llm.common import arrow_map, written
from siftline.llm.words import mixed

RUN, ENDS_BLOCK, _BLOCK = 4096, 8192, 1 << 16
ROWS, LEAST_BITS, MOST_BITS = 3, 16, 25
_EMPTY = hashlib.sha256(b"").hexdigest()
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _packed(conversations: DataFrame, conv: str, turn: str, role: str, text: str, most: int) -> DataFrame:
    """Runs of turns: conv, start (place of the first), ids, chars (packed), n (turns
    of the conversation), runs (of the conversation)."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    narrow = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))).alias("id"),
        F.char_length(said).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv", "turn", "id", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, of, run_no, held, sizes, out = TaskContext.get().partitionId(), None, 0, [], [], []

        def close() -> None:
            nonlocal run_no
            if held:
                out.append((of, part, run_no, len(held), b"".join(held), np.concatenate(sizes).tobytes()))
                held.clear(), sizes.clear()
                run_no += 1

        def done() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["conv", "part", "run", "m", "ids", "chars"])

        for batch in batches:
            convs = batch.column(0).to_numpy(zero_copy_only=False)
            ids, chars = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False).astype("<i8")
            edges = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1], [True]])) if len(convs) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                c = int(convs[a])
                if c != of:
                    close()
                    of, run_no = c, 0
                while a < b:
                    end = min(b, a + most - len(held))
                    held.extend(ids[a:end]), sizes.append(chars[a:end])
                    a = end
                    if len(held) == most:
                        close()
            if len(out) >= 256:
                yield done()
                out.clear()
        close()
        if out:
            yield done()

    sorted_ = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = written(arrow_map(sorted_, run, "conv long, part int, run int, m int, ids binary, chars binary", rows=4096), "turn-runs")
    several = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("conv")
    of_conv = Window.partitionBy("conv")
    before = of_conv.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(runs.select("conv", "part", "run", "m").join(several, "conv", "left_semi").select(
        "conv", "part", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(of_conv).alias("n"),
        F.count(F.lit(1)).over(of_conv).alias("runs")), "run-starts")
    return runs.join(starts, ["conv", "part", "run"], "left").select(
        "conv", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("n", "m").alias("n"), F.coalesce("runs", F.lit(1)).alias("runs"), "ids", "chars")


def _lanes(ids: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Two 64-bit values of every (depth, turn)."""
    a, b, d = ids[:, 0], ids[:, 1], depth.astype(np.uint64)
    return np.stack([mixed(a ^ mixed(b + d * _STEP[0])), mixed(b ^ mixed(a + d * _STEP[1]))], axis=1)


def _rebuilt(packed: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Runs of the conversations after their first `head` turns were replaced by
    those of conversation `base` (`most`: no head is longer): conv, start, runs, first
    (depth of the run's first turn), last (of the conversation), lanes (sums of the
    run's prefixes, two words of 64 bits each), chars, and the run's total in 32-bit
    halves."""
    heads = packed.where(F.col("start") < most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct(
        "start", F.substring("ids", 1, 16 * most).alias("ids"), F.substring("chars", 1, 8 * most).alias("chars")))).alias("heads"))
    rows = packed.withColumns({"base": base, "h": F.least(F.greatest(head.cast("int"), F.lit(0)), F.lit(most))}).join(heads, "base", "left").select(
        "conv", "start", "n", "runs", "ids", "chars", F.coalesce("h", F.lit(0)).alias("h"), "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = [pa.int64()] * 4
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                h, ids = r["h"], np.frombuffer(r["ids"], np.uint64).reshape(-1, 2)
                chars, skip = np.frombuffer(r["chars"], "<i8"), max(0, h - r["start"])
                lent = r["heads"] or []
                lent_ids = np.concatenate([np.frombuffer(x["ids"], np.uint64).reshape(-1, 2) for x in lent] or [ids[:0]])[:h]
                lent_chars = np.concatenate([np.frombuffer(x["chars"], "<i8") for x in lent] or [chars[:0]])[:h]
                first = max(r["start"], h) - h + len(lent_ids) + 1
                ids, chars = ids[skip:], chars[skip:]
                if r["start"] == 0:
                    ids, chars, first = np.concatenate([lent_ids, ids]), np.concatenate([lent_chars, chars]), 1
                sums = np.cumsum(_lanes(ids, first + np.arange(len(ids))), axis=0, dtype=np.uint64)
                total = sums[-1].tolist() if len(sums) else [0, 0]
                out.append((r["conv"], r["start"], r["runs"], first, len(lent_ids) + max(r["n"] - h, 0), sums.tobytes(), chars.tobytes(),
                            *(x for t in total for x in (t >> 32, t & 0xFFFFFFFF))))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *longs)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _RUN_NAMES)

    runs = written(arrow_map(rows, run, _RUN_KIND, rows=256), "prefix-runs")
    before = Window.partitionBy("conv").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    halves = ["a1", "a0", "b1", "b0"]
    offsets = written(runs.where("runs > 1").select("conv", "start", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o{c}") for c in halves)), "run-offsets")
    return runs.drop(*halves).join(offsets, ["conv", "start"], "left")


_RUN_NAMES = ["conv", "start", "runs", "first", "last", "lanes", "chars", "a1", "a0", "b1", "b0"]
_RUN_KIND = "conv long, start long, runs long, first long, last long, lanes binary, chars binary, a1 long, a0 long, b1 long, b0 long"


def _prefixes(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the prefixes that a run ends, and of the one before the run."""
    offset = np.array([((r[f"o{x}1"] or 0) << 32) + (r[f"o{x}0"] or 0) & 0xFFFFFFFFFFFFFFFF for x in "ab"], np.uint64)
    return np.frombuffer(r["lanes"], np.uint64).reshape(-1, 2) + offset, offset


def _cells(digests: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(digests[:, 0] + mixed(digests[:, 1] ^ _STEP[i])) >> np.uint64(64 - bits)).astype(np.int64) for i in range(ROWS)]


def _sketch(runs: DataFrame, bits: int) -> np.ndarray:
    """Per row of the sketch, a bit for every cell that counted two prefixes or more.
    Tasks hand out the blocks they touched; blocks of one place are added up as they
    stream by."""

    size = min(_BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((ROWS, 1 << bits), np.uint8)
        for batch in batches:
            found = [_prefixes(r)[0] for r in batch.to_pylist()]
            if found:
                for row, at in zip(cells, _cells(np.concatenate(found), bits), strict=True):
                    at, n = np.unique(at, return_counts=True)
                    row[at] = np.minimum(row[at] + n, 2)
        for i, row in enumerate(cells):
            blocks = row.reshape(-1, size)
            for b in np.flatnonzero(blocks.any(axis=1)).tolist():
                yield pa.RecordBatch.from_pylist([{"row": i, "block": b, "once": np.packbits(blocks[b] >= 1).tobytes(),
                                                   "twice": np.packbits(blocks[b] >= 2).tobytes()}], block_kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"row": at[0], "block": at[1], "once": once.tobytes(), "twice": twice.tobytes()}], block_kind)

        at = None
        for batch in batches:
            for r in batch.to_pylist():
                o, t = np.frombuffer(r["once"], np.uint8), np.frombuffer(r["twice"], np.uint8)
                if at == (r["row"], r["block"]):
                    once, twice = once | o, twice | t | (once & o)
                    continue
                if at is not None:
                    yield out()
                at, once, twice = (r["row"], r["block"]), o, t
        if at is not None:
            yield out()

    block_kind = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    kind = "row int, block int, once binary, twice binary"
    parts = arrow_map(runs.select("lanes", "oa1", "oa0", "ob1", "ob0"), count, kind, rows=256)
    whole = arrow_map(parts.repartition("row", "block").sortWithinPartitions("row", "block"), add, kind, rows=16)
    table = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in whole.select("row", "block", "twice").collect():  # at most 3 x 2^bits bits
        table[r["row"], r["block"] * (size // 8): (r["block"] + 1) * (size // 8)] = np.frombuffer(r["twice"], np.uint8)
    return table


def _screened(runs: DataFrame, twice, bits: int) -> DataFrame:
    """One row per prefix of every conversation, the empty one included: tail (in
    a proven tail), conv, depth, the prefix's and its parent's digest, chars, last (its
    conversation ends there), opens (the next prefix is the first of the tail), fresh
    (it is that first one)."""

    def proven(digests: np.ndarray) -> np.ndarray:
        shared = np.ones(len(digests), bool)
        for row, at in zip(twice.value, _cells(digests, bits), strict=True):
            shared &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ~shared

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["conv"], r["first"] + int(p[0])) for r in batch.to_pylist() if len(p := np.flatnonzero(proven(_prefixes(r)[0])))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], ["conv", "lone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                digests, before = _prefixes(r)
                depth, chars = r["first"] + np.arange(len(digests)), np.frombuffer(r["chars"], "<i8")
                parents = np.concatenate([before[None], digests])[:-1]
                if r["start"] == 0:
                    digests, parents = np.concatenate([before[None], digests]), np.concatenate([before[None], parents])
                    depth, chars = np.concatenate([[0], depth]), np.concatenate([[0], chars])
                if not len(depth):
                    continue
                lone = r["lone"]
                if lone is None:
                    p = np.flatnonzero(proven(digests) & (depth > 0))
                    lone = int(depth[p[0]]) if len(p) else 1 << 62
                out.append((np.full(len(depth), r["conv"]), depth, depth >= lone, depth == r["last"], (depth + 1 == lone) & (depth < r["last"]),
                            depth == lone, digests.view(np.int64), parents.view(np.int64), chars))
            if out:
                conv, depth, tail, last, opens, fresh, own, up, chars = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tail, conv, depth, own[:, 0], own[:, 1], up[:, 0], up[:, 1], chars, last, opens, fresh)],
                    ["tail", "conv", "depth", "d1", "d2", "p1", "p2", "chars", "last", "opens", "fresh"])

    several = arrow_map(runs.where("runs > 1"), firsts, "conv long, lone long", rows=256).groupBy("conv").agg(F.min("lone").alias("lone"))
    # Conversations of one run find the start of their tail by themselves.
    told = runs.join(written(several, "tails"), "conv", "left").withColumn(
        "lone", F.when(F.col("runs") > 1, F.coalesce("lone", F.lit(1 << 62))))
    return arrow_map(told, run, "tail boolean, conv long, depth long, d1 long, d2 long, p1 long, p2 long, chars long, last boolean, opens boolean, fresh boolean", rows=256)


def _ends(shared: DataFrame) -> DataFrame:
    """(d1, d2, ends): the digest of the ids, in order, of conversations that end there."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            at, ids = held[0][:2], [c for *_, c in held]
            return pa.RecordBatch.from_pylist([{"d1": at[0], "d2": at[1], "conv": ids[0], "ids": ",".join(map(str, ids))}], kind)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == ENDS_BLOCK):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = h = None
        rows = (r for batch in batches for r in batch.to_pylist())
        for at, blocks in groupby(rows, key=lambda r: (r["d1"], r["d2"])):
            h = hashlib.sha256()
            for i, r in enumerate(blocks):
                h.update(("," * (i > 0) + r["ids"]).encode())
            yield pa.RecordBatch.from_pylist([{"d1": at[0], "d2": at[1], "ends": h.hexdigest()}], end_kind)

    kind = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("conv", pa.int64()), ("ids", pa.string())])
    end_kind = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends", pa.string())])
    order = ["d1", "d2", "conv"]
    rows = shared.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = arrow_map(rows, spell, "d1 long, d2 long, conv long, ids string", rows=4096).repartition("d1", "d2").sortWithinPartitions(*order)
    return arrow_map(blocks, digest, "d1 long, d2 long, ends string", rows=64)


def _to_ancestors(shared: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(d1, d2, n_leaves, saved): sums over every shared node's subtree."""
    weight = (F.col("n_convs") - 1) * F.col("chars")
    leaf = (F.col("n_children") == 0).cast("long")
    own = nodes.select("conv", "depth", weight.alias("saved"), leaf.alias("leaves")).where("saved > 0 or leaves > 0")
    rows = shared.select("conv", "depth", "d1", "d2", F.col("opens").cast("long").alias("opens")).join(own, ["conv", "depth"], "left").select(
        "conv", "depth", F.floor(F.col("depth") / most).alias("run"), "d1", "d2", F.coalesce("saved", F.lit(0)).alias("saved"),
        (F.coalesce("leaves", F.lit(0)) + F.col("opens")).alias("leaves"))
    below = Window.partitionBy("conv", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("conv", "run", "depth", "d1", "d2", F.sum("saved").over(below).alias("saved"), F.sum("leaves").over(below).alias("leaves"))
    after = Window.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    long_ = rows.where(F.col("run") > 0).select("conv").distinct()
    later = rows.join(long_, "conv", "left_semi").groupBy("conv", "run").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).select(
        "conv", "run", F.sum("s").over(after).alias("more_saved"), F.sum("l").over(after).alias("more_leaves"))
    whole = within.join(written(later, "later-runs"), ["conv", "run"], "left").select(
        "d1", "d2", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
    return whole.where("saved > 0 or leaves > 0").groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         base: Column | None = None, head: Column | None = None, most_head: int = 0, most_bits: int = MOST_BITS, run: int = RUN) -> DataFrame:
    """One row per distinct prefix: conv_id (smallest conversation that starts with
    it), depth, parent_conv_id (null: the root), n_convs, n_children, n_leaves (of the
    subtree), saved_tokens (summed over the subtree: n_convs less one, times the
    characters of a node's last text), ends_sha256 (of the ids that end there).
    `base`, `head` (over the column `conv`): the first `head` turns, `most_head` at most,
    are replaced by those of conversation `base`."""
    packed = written(_packed(conversations, conv, turn, role, text, run), "packed")
    runs = written(_rebuilt(packed, F.lit(None).cast("long") if base is None else base, F.lit(0) if head is None else head, most_head), "runs")
    n = runs.agg(F.sum(F.length("lanes"))).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, int(4 * n / 16 + 1).bit_length()))
    twice = conversations.sparkSession.sparkContext.broadcast(_sketch(runs, bits))
    prefixes = written(_screened(runs, twice, bits), "prefixes")

    shared = prefixes.where("not tail")
    grouped = written(shared.groupBy("d1", "d2").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"), F.sum(F.col("opens").cast("long")).alias("opens")), "groups")
    children = grouped.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("inner"))
    nodes = written(grouped.join(children, ["d1", "d2"], "left").withColumn(
        "n_children", F.coalesce("inner", F.lit(0)) + F.col("opens")).drop("inner", "opens"), "nodes")
    root = nodes.where("depth = 0").select("conv").first()

    full = nodes.join(_to_ancestors(shared, nodes, run), ["d1", "d2"], "left").join(_ends(shared), ["d1", "d2"], "left").select(
        "conv", "depth", "p1", "p2", "n_convs", "n_children", "n_leaves", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"))
    tails = prefixes.where("tail").select(
        "conv", "depth", "p1", "p2", "fresh", F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends"))
    every = full.withColumn("fresh", F.lit(True)).unionByName(tails)
    # Below the root, and inside a tail, the parent's smallest conversation is known.
    known = every.where("depth < 2 or not fresh").withColumn("parent", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")).when(
        F.col("depth") > 1, F.col("conv")))
    names = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))
    asked = every.where("depth >= 2 and fresh").join(names, ["p1", "p2"], "left")
    return known.unionByName(asked).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
