"""Repeated passages by suffix automata of reference shards.

A window is `WINDOW` consecutive words. A word is removed when a window over it
also starts in a document of a smaller key, judged on the input.

Every window names an anchor, the smallest hash of its `GRAM`-word runs, so equal
windows name equal anchors, and a text of n words has about n / 22 of them.

1. Equal texts count once, for their smallest key. (A later copy loses all words
   that windows cover.) Anchors that stand in one text only need no further look.
2. Texts with shared anchors give spans: the words of all neighbouring windows that
   name the same anchor. Equal spans are one reference, owned by their smallest key.
3. References are dealt by anchor into shards of about `SHARD_WORDS`. A task builds
   the suffix automaton of a shard, with the smallest owner of every state, and
   streams the shard's spans through it: the state of the last WINDOW words tells
   the first document with that window. Automata go to the spans that share their
   anchors, not to every document, so work grows with what repeats.
4. Texts take the windows that a smaller key owns, and drop the words they cover.

An anchor with more than `HOT_SPANS` different spans (a passage that very many
documents run into their own words) takes no part in 3: no shard could hold its spans.
Their windows are shuffled by a 128-bit digest of their words, where minima of owners
are combined on the map side, and get their first owner by a join. Windows that are
themselves in more than `HOT_SPANS` spans are few and joined apart, so no task holds
or reads a group.

A null text has no words; texts under WINDOW words lose nothing. Rows without a key
neither lose nor own words. Rows that share a key do not remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import arrow_map, written
from siftline.llm.screen import may_be_among
from siftline.llm.words import runs, shingles, words_of

WINDOW, GRAM = 50, 8
SHARD_WORDS, HOT_SPANS = 1 << 16, 4096


def _anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that name the same anchor: their anchors and bounds, one
    bound more than anchors."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    gram = min(GRAM, window)
    grams = shingles(hashes, gram)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n)
    bounds = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [n]])
    return grams[at][bounds[:-1]], bounds


class Automaton:
    """Suffix automaton of several word sequences; a state's owner is the smallest
    owner of the sequences that hold its strings."""

    def __init__(self, sequences: list[list], owners: list):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        for words, owner in zip(sequences, owners, strict=True):
            last = 0
            for w in words:
                last = self._extend(last, w)
                if self.owner[last] is None or owner < self.owner[last]:
                    self.owner[last] = owner
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[s], self.owner[s]
            if self.owner[up] is None or own < self.owner[up]:
                self.owner[up] = own

    def _state(self, length: int, after: dict, link: int) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length), self.owner.append(None)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w) -> int:
        """The state of q's strings up to p's length and `w`, cut off from q."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def first_owners(self, words: list, window: int) -> list:
        """The smallest owner of every window of a sequence; None: in no sequence.
        Matching statistics, kept at `window` words at most."""
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            if matched >= window:
                matched = window
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
            if i >= window - 1:
                out.append(self.owner[state] if matched == window else None)
        return out


def _by_windows(references: DataFrame, kind: str, window: int, hot_spans: int) -> DataFrame:
    """span, owners: the smallest owner of every window of the references (span,
    owner, words), without bringing an anchor's spans together."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, digests = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                words = text.split(b" ")
                n = len(words) - window + 1
                row += [i] * n
                at += range(n)
                digests += [hashlib.blake2b(b" ".join(words[k: k + window]), digest_size=16).digest() for k in range(n)]
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(at, pa.int32()),
                                              pa.array(digests, pa.binary())], ["span", "owner", "at", "window"])

    windows = arrow_map(references.select("span", "owner", "words"), split, f"span binary, owner {kind}, at int, window binary")
    firsts = written(windows.groupBy("window").agg(F.min("owner").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "window-owners")
    common = written(firsts.where(F.col("n") > hot_spans).select("window", F.col("first").alias("a")), "common-windows")
    # What is found among the common windows gets a key of its own, longer than a digest.
    placed = windows.join(common, "window", "left").withColumn(
        "window", F.when(F.col("a").isNull(), F.col("window")).otherwise(F.concat("span", F.encode(F.col("at").cast("string"), "utf-8"))))
    rare = firsts.where(F.col("n") <= hot_spans).select("window", F.col("first").alias("b"))
    owners = placed.join(rare, "window", "left").groupBy("span").agg(
        F.array_sort(F.collect_list(F.struct("at", F.least("owner", "a", "b").alias("o")))).alias("found"))
    return written(owners.select("span", F.transform("found", lambda x: x["o"]).alias("owners")), "hot-owners")


def _owned_windows(docs: DataFrame, kind: str, window: int, hot_spans: int) -> tuple[DataFrame, DataFrame]:
    """(texts, found). texts: key, digest, first (the smallest key of that text).
    found: digest, key, and starts of windows that smaller keys own, in pieces."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for _, some in runs([(t or "").encode() for t in b.column(2).to_pylist()]):
                w = words_of(some)
                made += [np.unique(_anchored(w.hashes[x:y], window)[0]).view(np.int64).tolist() for x, y in pairwise(w.first)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(made, pa.list_(pa.int64()))], ["key", "digest", "anchors"])

    base = written(arrow_map(docs, anchors, f"key {kind}, digest string, anchors array<long>"), "anchors").where("key is not null")
    firsts = base.groupBy("digest").agg(F.min("key").alias("first"))
    texts = base.select("key", "digest").join(firsts, "digest").distinct()
    owners = base.join(firsts.withColumnRenamed("first", "key"), ["digest", "key"]).dropDuplicates(["digest"]).select(
        "digest", "key", F.explode("anchors").alias("anchor"))
    shared = owners.groupBy("anchor").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("anchor")
    wanted = written(owners.join(shared, "anchor").groupBy("digest", "key").agg(F.collect_list("anchor").alias("anchors")), "wanted")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "key", "start", "anchor", "span", "n", "words"]
        for b in batches:
            rows = {n: [] for n in names}
            for d, k, text, chosen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                words = data.split()
                found, bounds = _anchored(words_of([data]).hashes, window)
                for i in np.flatnonzero(np.isin(found, np.array(chosen, np.int64).view(np.uint64))).tolist():
                    start, end = int(bounds[i]), int(bounds[i + 1]) + window - 1
                    span = b" ".join(words[start:end])
                    for n, v in zip(names, (d, k, start, int(found[i].astype(np.int64)), xxhash.xxh3_128_digest(span), end - start, span), strict=True):
                        rows[n].append(v)
            types = (pa.string(), b.schema.types[1], pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types, strict=True)], names)

    # Texts without a shared anchor are not shuffled.
    chosen = docs.where(may_be_among(F.col("key"), wanted.select("key"))).join(wanted, ["key", "digest"]).select("digest", "key", "text", "anchors")
    seen = written(arrow_map(chosen, spans, f"digest string, key {kind}, start int, anchor long, span binary, n int, words binary"), "spans")
    references = seen.groupBy("anchor", "span").agg(F.min("key").alias("owner"), F.max("n").alias("n"), F.max("words").alias("words"))
    references = written(references, "references")
    crowded = written(references.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans")).where(F.col("spans") > hot_spans), "hot-anchors")
    any_hot = not crowded.isEmpty()
    pieces = references.join(crowded.select("anchor"), "anchor", "left_anti") if any_hot else references
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = int(total // SHARD_WORDS) + 1

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if x[0] != at and held:
                    yield from answered(held, b.schema.types[2])
                    held = []
                at = x[0]
                held.append(x[1:])
        if held:
            yield from answered(held, b.schema.types[2])

    def answered(shard: list[tuple], owner: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for _, _, words in shard]
        automaton = Automaton(sequences, [own for _, own, _ in shard])
        for i in range(0, len(shard), 512):
            firsts = [automaton.first_owners(s, window) for s in sequences[i: i + 512]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([span for span, _, _ in shard[i: i + 512]], pa.binary()), pa.array(firsts, pa.list_(owner))], ["span", "owners"])

    # A shard comes to its task row by row and is never one row of the JVM's.
    dealt = pieces.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "span", "owner", "words") \
        .repartition("shard").sortWithinPartitions("shard")
    answers = written(arrow_map(dealt, stream, f"span binary, owners array<{kind}>"), "first-owners")
    if any_hot:
        answers = answers.unionByName(_by_windows(references.join(crowded.select("anchor"), "anchor", "left_semi"), kind, window, hot_spans))
    mine = seen.select("digest", "key", "start", "span").join(answers, "span")
    at = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("key"), F.col("start") + i)), lambda x: x.isNotNull())
    return texts, mine.select("digest", "key", at.alias("at")).where(F.size("at") > 0)


def _cut(docs: DataFrame, key: str, text: str, window: int, hot_spans: int) -> tuple[DataFrame, str]:
    """Every input row (struct `doc`) with its text, whether it is a copy of an
    earlier text, and the starts of windows to take out."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"),
                       F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    texts, found = _owned_windows(rows.select("key", "digest", "text"), kind, window, hot_spans)

    # A window's first owner is unaffected by which copy of a text asks.
    taken = found.groupBy("digest", "key").agg(F.flatten(F.collect_list("at")).alias("at"))
    plan = texts.where("key <> first").select("key", "digest", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("at")) \
        .unionByName(taken.select("key", "digest", F.lit(False).alias("copy"), "at"))
    plan = written(plan, "removal-plan")
    # Texts that surely lose nothing stay where they are.
    maybe = may_be_among(F.col("key"), plan.select("key"))
    whole = rows.where(~maybe).select("doc", "key", "text", F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<int>").alias("at"))
    return whole.unionByName(rows.where(maybe).join(plan, ["key", "digest"], "left").select("doc", "key", "text", "copy", "at")), kind


def _kept_words(text: str | None, copy: bool | None, at: list[int] | None, window: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """All words, the kept ones, and a mask of the removed."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    if copy and len(words) >= window:
        gone[0] = 1
    elif at:
        starts = np.unique(np.asarray(at, np.int64))
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + window, -1)
    mask = np.cumsum(gone)[:-1] > 0
    return words, [w for w, m in zip(words, mask.tolist(), strict=True) if not m], mask


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
             hot_spans: int = HOT_SPANS) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_sha256 (of the kept
    words joined by spaces), and `removed`, the maximal word ranges taken out."""
    planned, kind = _cut(docs.select(key, text), key, text, window, hot_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha, ranges = [], [], [], []
            for text_, copy, at in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words, kept, mask = _kept_words(text_, copy, at, window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                n.append(len(words)), removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest()), ranges.append(edges.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(ranges, pa.list_(pa.list_(pa.int32())))], [key, "n_words", "n_removed", "kept_sha256", "removed"])

    return arrow_map(planned.select("key", "text", "copy", "at"), run,
                     f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
           hot_spans: int = HOT_SPANS) -> DataFrame:
    """The input rows with the repeated passages taken out of their texts. A text
    that loses nothing stays as it is; one that loses something keeps the white
    space behind its kept words; one that loses all its words is dropped."""
    planned, _ = _cut(docs, key, text, window, hot_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text_, copy, at in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words, kept, mask = _kept_words(text_, copy, at, window)
                if not mask.any():
                    out.append(text_)
                elif not kept:
                    out.append(None)
                else:
                    w = words_of([text_.encode()])
                    keep = np.flatnonzero(~mask)
                    ends = np.append(w.starts, len(w.data))[keep + 1]
                    out.append(b"".join(w.data[a:e] for a, e in zip(w.starts[keep].tolist(), ends.tolist(), strict=True)).decode().rstrip())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.string()), pa.array([t is None or o is not None for t, o in zip(
                    b.column(1).to_pylist(), out, strict=True)])], ["doc", "text", "stays"])

    kept = arrow_map(planned.select("doc", "text", "copy", "at"), run,
                     f"doc {planned.schema['doc'].dataType.simpleString()}, text string, stays boolean").where("stays")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
