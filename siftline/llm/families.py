"""Sets that may be similar, in families: which of them links join.

A family's sets come to a task once, in chunks of what it holds. In a chunk, an index
from shingles to sets gives a set's overlap with all others at once; only sets outside
the largest component need be asked. A family of several chunks is dealt anew, and
what then is not one component is tested exactly: sets outside the family's largest
component, in blocks, against blocks of the whole family. The largest component is
never paired with itself, so rows grow with a family times the blocks of its rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import arrow_map, written
from siftline.llm.graph import components

CHUNK_NODES, CHUNK_SHINGLES = 2048, 1 << 22


def joined(sets: list[np.ndarray], head: np.ndarray, percent: int) -> np.ndarray:
    """`head` (per set the number of its component) after all links at that similarity
    between the sorted `sets`."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle that only one set has is in no overlap.
    common, owner = df[ids] > 1, np.repeat(np.arange(len(sets)), sizes)
    new = np.cumsum(df > 1) - 1
    ids, owner = new[ids[common]], owner[common]
    place = np.searchsorted(owner, np.arange(len(sets) + 1))
    postings, at = owner[np.argsort(ids, kind="stable")], np.concatenate([[0], np.cumsum(df[df > 1])])
    head, asked = head.copy(), np.zeros(len(sets), bool)
    while True:
        labels, n = np.unique(head, return_counts=True)
        most = labels[np.argmax(n)]
        ask = np.flatnonzero(~asked & (head != most))
        if not len(ask):
            return head
        for q in ask.tolist():
            # A set that has come to the largest component meanwhile may wait.
            if head[q] == most:
                continue
            asked[q] = True
            mine = ids[place[q]: place[q + 1]]
            spans = at[mine + 1] - at[mine]
            hits = np.repeat(at[mine] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            both = np.bincount(postings[hits], minlength=len(sets))
            near = head[(100 * both >= percent * (sizes[q] + sizes - both)) & (head != head[q])]
            if len(near):
                to, near = (most if (near == most).any() else head[q]), np.append(near, head[q])
                head[np.isin(head, near)] = to


def _hashes(held: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in held]


def _links(groups: DataFrame, kind: str, percent: int, sets_of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """Links (a, b) within every group (members: node, own, shingles), from each
    component's first node; nodes of one `own` are joined beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            node_type = batch.schema.types[0].value_type.field("node").type
            for members in batch.column(0):
                rows = members.values
                names, own = rows.field("node").to_pylist(), rows.field("own").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                head, first = joined(sets_of(rows.field("shingles")), own, percent), {}
                for i, h in enumerate(head.tolist()):
                    if (j := first.setdefault(h, i)) != i:
                        a.append(names[j]), b.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, node_type), pa.array(b, node_type)], ["a", "b"])

    return arrow_map(groups, run, f"a {kind}, b {kind}", rows=4)


def chunked(placed: DataFrame) -> DataFrame:
    """`placed` (comp, node, n) with `chunks`, how many a family needs."""
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).where("c > 1").select(
        "comp", F.ceil(F.greatest(F.col("c") / CHUNK_NODES, F.col("s") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    return placed.join(sizes, "comp")


def linked(sets: DataFrame, kind: str, percent: int, sets_of: Callable[[pa.Array], list[np.ndarray]] = _hashes) -> DataFrame:
    """(node, comp): per node with a link the smallest node that links reach. `sets`:
    a written table of comp, node, chunks, shingles (sorted 64-bit hashes, or what
    `sets_of` makes them of); repeated rows are one node."""
    members = F.collect_set(F.struct("node", "own", "shingles")).alias("members")
    links, labels = None, None
    for turn in (0, 1):
        # The second time only families that chunks have kept apart, dealt otherwise.
        rows = sets.withColumn("own", F.col("node")) if labels is None else _apart(sets, labels).where("small > 0")
        chunk = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("chunks"))
        groups = rows.withColumn("chunk", chunk).groupBy("comp", "chunk").agg(members).select("members")
        found = written(_links(groups, kind, percent, sets_of), "links")
        links = found if links is None else written(links.unionByName(found), "links")
        labels = components(links)
        if sets.where("chunks > 1").isEmpty():
            return labels
    rows = written(_apart(sets, labels).where("small > 0"), "apart")
    if rows.isEmpty():
        return labels
    rest = F.ceil(F.col("small") / CHUNK_NODES).cast("int")
    block, slice_ = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "node"), rest).cast("int")
    every = rows.select("comp", "node", "own", "shingles", F.explode(F.sequence(F.lit(0), rest - 1)).alias("i"), block.alias("j"))
    small = rows.where("not large").select(
        "comp", "node", "own", "shingles", slice_.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    crossed = every.unionByName(small).groupBy("comp", "i", "j").agg(members).select("members")
    return components(written(links.unionByName(_links(crossed, kind, percent, sets_of)), "links"))


def _apart(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the families of several chunks with their component (own), whether it
    is the family's largest (large), and how many rows are outside of that (small)."""
    rows = sets.where("chunks > 1").join(labels.withColumnRenamed("comp", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    of_own = rows.groupBy("comp", "own").agg(F.count(F.lit(1)).alias("c"))
    best = of_own.groupBy("comp").agg(F.max(F.struct("c", "own")).alias("top"), F.sum("c").alias("all")).select(
        "comp", F.col("top.own").alias("top"), (F.col("all") - F.col("top.c")).alias("small"))
    return rows.join(best, "comp").withColumn("large", F.col("own") == F.col("top")).drop("top")
