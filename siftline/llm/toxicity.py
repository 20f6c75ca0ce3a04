"""Toxicity by a subsequence string kernel, a support vector machine and Nyström
landmarks.

The kernel of two words sums over the letter subsequences of length 3 to 5 that
both hold, each weighed by `DECAY` for every letter it stretches over (at most
`SPAN`), so inserted characters and gaps weaken a match and don't end it. Letters
spaced out one by one are taken as one word. A word's start counts as a letter.

Sentences get their document's label. A word is not labelled, so those of toxic
sentences count as toxic that hold a letter sequence toxic documents have
significantly more often; all words of clean sentences count as clean. The machine
is trained on the kernel to `LANDMARKS` words only; with its landmarks it becomes
one weight per subsequence, so a word costs time linear in its length.

A document's score comes from its three highest word scores and the number of
words beyond the border, by a logistic curve fitted on documents. Every word of
every text is scored; nothing but the text is an input.

The model is fitted on the driver, on at most `FIT_DOCS` labelled documents of a
class and `FIT_BYTES` of text, taken in the order of a hash of their ids. A text that
would take more than a `FIT_PARTS`-th of its class's bytes is represented by sentences
spread over all of it, so a few long texts can't crowd out the others. Without
documents of both classes every score is the share of toxic ones (0 without any).
Null and empty texts have the lowest score the curve gives.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Memo, arrow_map

DECAY, SPAN, LANDMARKS, ROUNDS = 0.6, 7, 200, 3
FIT_DOCS, FIT_BYTES, FIT_PARTS = 2000, 12 << 20, 16
_GRAM_BUCKETS = 1 << 21
_BUCKETS, _MEMO = 1 << 20, 1 << 19
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_MARKS = re.compile(r"[^\w\s]+|_+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
#: Places of a subsequence after its first letter, and its weight.
_SHAPES = [(s, DECAY ** (s[-1] + 1)) for k, span in ((2, SPAN), (3, SPAN), (4, SPAN - 1)) for s in combinations(range(1, span), k)]
_SQUARES = np.array([sum(w * w for s, w in _SHAPES if s[-1] == d) for d in range(SPAN)])


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s]


def words(sentence: str) -> list[str]:
    """Lower-case words without punctuation; three single letters or more in a row
    are one word."""
    bare = _MARKS.sub("", sentence.lower())
    return _SPACED.sub(lambda m: "".join(m[0].split()), bare).split()


def _features(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every shape: its buckets at every letter of the joined words, where it
    fits there, its weight."""
    pad = "\x01" * (SPAN - 1)
    codes = np.frombuffer("".join("\x02" + w + pad for w in some).encode("utf-32-le"), np.uint32)
    n = max(0, len(codes) - SPAN + 1)
    at = [codes[d: n + d] for d in range(SPAN)]
    fits = [(at[0] != 1) & (a != 1) for a in at]
    begun: dict[tuple[int, ...], np.ndarray] = {(): at[0] * np.uint32(0x9E3779B1)}
    for shape, weight in _SHAPES:
        if shape[:-1] not in begun:
            begun[shape[:-1]] = (begun[shape[:-2]] + at[shape[-2]]) * np.uint32(0x9E3779B1)
        h = (begun[shape[:-1]] + at[shape[-1]]) * np.uint32(0x85EBCA6B) + np.uint32(len(shape) * 0x27D4EB2F)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(12), fits[shape[-1]], weight


def _of_word(some: list[str]) -> np.ndarray:
    return np.repeat(np.arange(len(some)), [len(w) + SPAN for w in some])


def _sizes(some: list[str]) -> np.ndarray:
    """Root of the sum of squares over a word's subsequences."""
    lengths = np.fromiter(map(len, some), np.int64, len(some)) + 1
    return np.sqrt(np.maximum((np.maximum(0, lengths[:, None] - np.arange(SPAN)) * _SQUARES).sum(axis=1), 1e-9))


def _vectors(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' feature vectors as (word, bucket, value) with unit diagonal."""
    word, sizes, rows, buckets, values = _of_word(some), _sizes(some), [], [], []
    for h, fits, weight in _features(some):
        on = np.flatnonzero(fits)
        rows.append(word[on]), buckets.append(h[on].astype(np.int64)), values.append(weight / sizes[word[on]])
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last column is
    the threshold and not penalised."""
    ridge, w = np.append(np.ones(x.shape[1] - 1), 1e-6), np.zeros(x.shape[1])
    for _ in range(30):
        left, right = np.diag(ridge), np.zeros(x.shape[1])
        for at in range(0, len(x), 2048):
            part, target = x[at: at + 2048].astype(np.float64), y[at: at + 2048]
            c = 2 * cost * weight[at: at + 2048] * (target * (part @ w) < 1)
            left = left + (part * c[:, None]).T @ part
            right += part.T @ (c * target)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (p - y)) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights of subsequences, and the curve over a document's features."""

    def __init__(self, texts: list[str], toxic: list[int], share: float | None = None):
        """`share` of toxic documents among all, if not as in these."""
        self.prior = sum(toxic) / max(1, len(toxic)) if share is None else share
        self.curve = None
        if 0 < sum(toxic) < len(toxic):
            self._fit(texts, np.array(toxic))

    def _fit(self, texts: list[str], toxic: np.ndarray) -> None:
        ids: dict[str, int] = {}
        docs = [np.array([ids.setdefault(w, len(ids)) for s in sentences(t) for w in words(s)], np.int32) for t in texts]
        every, n = list(ids), np.bincount(toxic, minlength=2)
        grams = [_grams(w) for w in every]
        in_docs, gram_docs = np.zeros((2, len(every)), np.int32), np.zeros((2, _GRAM_BUCKETS), np.int32)
        for own, label in zip(docs, toxic.tolist(), strict=True):
            own = np.unique(own)
            in_docs[label, own] += 1
            if len(own):
                gram_docs[label, np.unique(np.concatenate([grams[i] for i in own]))] += 1
        # Sequences that are surely more frequent in toxic documents.
        p, q, both = gram_docs[1] / n[1], gram_docs[0] / n[0], gram_docs.sum(axis=0) / n.sum()
        marks = (gram_docs[1] >= 4) & (p > 25 * q) & (p - q > 6 * np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1])))
        suspect = np.flatnonzero(in_docs[1] / n[1] > 10 * in_docs[0] / n[0])
        bad = [int(i) for i in suspect if marks[grams[i]].any()]
        bad = sorted(bad, key=lambda i: (-in_docs[1, i], every[i]))[:3000]
        del grams, gram_docs, marks, p, q, both
        if not bad:
            return
        chosen, random = set(bad), np.random.default_rng(7)
        clean = sorted((i for i in np.flatnonzero(in_docs[0]).tolist() if i not in chosen), key=lambda i: (-in_docs[0, i], every[i]))
        often, rest = clean[:3000], clean[3000:]
        start = [every[i] for i in often] + [every[rest[i]] for i in random.permutation(len(rest))[:7000]]
        clean, hard, known = [every[i] for i in clean], [], set(start)
        for _ in range(ROUNDS):
            self._train([every[i] for i in bad], in_docs[1, bad], start + hard, hard)
            # The clean words that look worst join the examples.
            scores = self.score_words(clean)
            new = [clean[i] for i in np.argsort(-scores, kind="stable")[:2000] if scores[i] > -0.7 and clean[i] not in known]
            hard, known = hard + new, known | set(new)
        scores = self.score_words(every)
        x, own = np.array([self.document(scores[d]) for d in docs]), toxic.mean()
        self.curve = _logistic(x, toxic, np.where(toxic == 1, self.prior / own, (1 - self.prior) / (1 - own)))

    def _train(self, bad: list[str], times: np.ndarray, clean: list[str], hard: list[str]) -> None:
        every, random = bad + clean, np.random.default_rng(9)
        y = np.append(np.ones(len(bad)), -np.ones(len(clean)))
        weight = np.append(np.sqrt(times) / np.sqrt(times).sum(), np.full(len(clean), 2 / len(clean))) * 4000
        marks = bad[: LANDMARKS // 2] + hard[: LANDMARKS // 4]
        marks += [clean[i] for i in random.permutation(len(clean))[: LANDMARKS - len(marks)]]
        rows, buckets, values = _vectors(marks)
        used = np.unique(buckets)
        place = np.full(_BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))

        def dense(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            on = place[buckets] >= 0
            at = rows[on] * len(used) + place[buckets[on]]
            return np.bincount(at, values[on], n * len(used)).astype(np.float32).reshape(n, -1)

        z = np.concatenate([dense(*_vectors(marks[i: i + 32]), len(marks[i: i + 32])) for i in range(0, len(marks), 32)])
        e, v = np.linalg.eigh((z @ z.T).astype(np.float64))
        root = (v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-4))) @ v.T).astype(np.float32)
        x = np.zeros((len(every), len(marks) + 1), np.float32)
        x[:, -1] = 1
        across = np.ascontiguousarray(z.T)
        for at in range(0, len(every), 64):
            rows, buckets, values = _vectors(every[at: at + 64])
            on = np.flatnonzero(place[buckets] >= 0)
            on = on[np.argsort(rows[on], kind="stable")]
            if len(on):
                word, first = np.unique(rows[on], return_index=True)
                held = across[place[buckets[on]]] * values[on, None].astype(np.float32)
                x[at + word, :-1] = np.add.reduceat(held, first, axis=0)
        x[:, :-1] = x[:, :-1] @ root
        w = _svm(x, y, weight)
        self.weights = np.zeros(_BUCKETS, np.float32)
        self.weights[used] = z.T @ (root @ w[:-1].astype(np.float32))
        self.border = float(w[-1])

    def score_words(self, some: list[str]) -> np.ndarray:
        out = np.zeros(len(some))
        for at in range(0, len(some), 2048):
            part = some[at: at + 2048]
            total = None
            for h, fits, weight in _features(part):
                found = self.weights[h] * (fits * np.float32(weight))
                total = found if total is None else total + found
            sums = np.bincount(_of_word(part)[: len(total)], total, len(part))
            out[at: at + 2048] = sums / _sizes(part) + self.border
        return out

    @staticmethod
    def document(scores) -> list[float]:
        found = np.fromiter(scores, np.float64)
        high = np.sort(np.partition(np.concatenate([found, [-2.0] * 3]), -3)[-3:])[::-1]
        return [*np.clip(high, -1.5, 1.5).tolist(), float(np.log1p((found > 0).sum()))]

    def probability(self, scores) -> float:
        if self.curve is None:
            return self.prior
        x = np.append(self.document(scores), 1.0) @ self.curve
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _grams(word: str) -> np.ndarray:
    """Buckets of the sequences of 4, 5, 6 and 8 letters; the start counts as one."""
    w = ("\x02" + word).encode()
    return np.array([zlib.crc32(w[i: i + k]) % _GRAM_BUCKETS for k in (4, 5, 6, 8) for i in range(len(w) - k + 1)], np.int32)


def spread(text: str, most: int) -> str:
    """The text, or sentences of it in their order, of at most `most` bytes with their
    ends: chosen by a hash, so from all over the text. Sentences of more than a
    quarter of that are taken in stretches of words."""
    if len(text.encode()) <= most:
        return text
    parts: list[str] = []
    for s in sentences(text):
        if len(s.encode()) <= most // 4:
            parts.append(s)
            continue
        held, size = [], 0
        for w in s.split():
            n = len(w.encode()) + 1
            if held and size + n > most // 4:
                parts.append(" ".join(held))
                held, size = [], 0
            held.append(w)
            size += n
        parts.append(" ".join(held))
    chosen, room = [], most
    for i in sorted(range(len(parts)), key=lambda i: (zlib.crc32(b"%d" % i), i)):
        n = len(parts[i].encode()) + 2
        if n <= room:
            chosen.append(i)
            room -= n
    return "".join(parts[i] + ".\n" for i in sorted(chosen))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        most: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Model:
    """A model of the texts that `labels` (key, label 0 or 1; other labels take no
    part) names. The sample is chosen among the labels, so only its own texts are
    moved: a broadcast of at most 2 * `most` keys picks them. A key that `docs` holds
    several times counts with its smallest text."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("label"), F.xxhash64(F.lit("fit"), F.col(key)).alias("h"))
    share = known.agg(F.avg("label")).first()[0]
    chosen = [r for v in (0, 1) for r in known.where(F.col("label") == v).orderBy("h", "k").limit(most).collect()]
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def of(rows: list) -> DataFrame:
        keys = spark.createDataFrame([(r["k"],) for r in rows], known.select("k").schema).distinct()
        return own.join(F.broadcast(keys), "k").groupBy("k")

    size = {r["k"]: r["n"] for r in of(chosen).agg(F.min(F.octet_length("t")).alias("n")).collect()}
    room, part = {0: most_bytes // 2, 1: most_bytes // 2}, most_bytes // 2 // FIT_PARTS
    taken = []
    for r in chosen:
        n = min(size.get(r["k"], 0), part)
        if r["k"] in size and n <= room[r["label"]]:
            room[r["label"]] -= n
            taken.append(r)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spread(t, part) for t in b.column(1).to_pylist()], pa.string())], ["k", "t"])

    texts = of(taken).agg(F.min_by("t", F.struct(F.octet_length("t"), "t")).alias("t"))
    found = {r["k"]: r["t"] for r in arrow_map(texts, shorten, f"k {known.schema['k'].dataType.simpleString()}, t string", rows=16).collect()}
    if len({r["label"] for r in chosen if r["k"] in size and size[r["k"]]}) == 2 and len({r["label"] for r in taken if found[r["k"]]}) < 2:
        raise ValueError(f"{most_bytes} bytes hold no labelled text of one of the classes")
    return Model([found[r["k"]] for r in taken], [r["label"] for r in taken], share or 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: key, score (0 to 1), predicted (1 from `threshold` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = Memo(lambda w: float(model.score_words([w])[0]), _MEMO)
        for b in batches:
            held = [words(t or "") for t in b.column(1).to_pylist()]
            if model.curve is not None:
                new = list({w for d in held for w in d if w not in memo})
                if len(memo) + len(new) > _MEMO:
                    memo.clear()
                    new = list({w for d in held for w in d})
                memo.update(zip(new, model.score_words(new).tolist(), strict=True))
            out = [model.probability(map(memo.__getitem__, d)) for d in held]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())],
                [key, "score", "predicted"])

    return arrow_map(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def fold(key: Column) -> Column:
    """0, 1 or 2: the crc32 of the key as text, modulo 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3
