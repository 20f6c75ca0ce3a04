"""Token counts: the pieces of every distinct pre-token are counted once, by the
tokenizer library, and joined to the pre-token frequencies of the documents; no
document's ids are made.

The most frequent pre-tokens, of any length (at most `HOT`, and of at most `HOT_BYTES`
bytes together, so a proven size), are broadcast: they are nearly all occurrences, and
their join keys would be the hot ones. All other pre-tokens take a shuffled equi join,
in which no key is frequent. Both parts are exact and do not depend on the input's size.

A null text counts as empty (0 tokens). Special strings in a text are one token
each, as is the library's default. Rows that share an id are counted one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import vocabulary
from siftline.llm.common import Memo, arrow_map, written

HOT, HOT_BYTES = 1 << 19, 16 << 20
_PART_SPANS = 1 << 18


def _segments(text: str, specials: list[str]) -> tuple[list[str], int]:
    """The text between special strings, and how many of them there are."""
    parts, n = [text], 0
    for s in specials:
        if s in text:
            parts = [q for p in parts for q in p.split(s)]
            n = len(parts) - 1
    return parts, n


def _specials(file: str) -> list[str]:
    return [t.content for t in vocabulary.tokenizer(file).get_added_tokens_decoder().values()]


def distinct_pretokens(texts: DataFrame, file: str) -> DataFrame:
    """(pretoken, n): every pre-token of column `text`, with the number of its
    occurrences over distinct spans of a task (a measure of how common it is)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, seen = _specials(file), set()

        def out() -> pa.RecordBatch:
            found = Counter(p for s in seen for p in vocabulary.pretokens(s, file))
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _segments(text or "", specials)[0]:
                    seen.update(vocabulary.spans(part))
            if len(seen) > _PART_SPANS:
                yield out()
                seen = set()
        yield out()

    found = arrow_map(texts.select("text"), collect, "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(found: DataFrame, file: str) -> DataFrame:
    """(pretoken, n, pieces): what the library makes of each pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = vocabulary.tokenizer(file)
        for batch in batches:
            made = t.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(e.ids) for e in made], pa.int32())], ["pretoken", "n", "pieces"])

    return arrow_map(found, count, "pretoken string, n long, pieces int", rows=4096)


def _hot(counted: DataFrame, limit: int) -> dict[str, int]:
    """The most frequent pre-tokens, at most `limit` and of at most `HOT_BYTES` bytes:
    those above the lowest power of 2^(1/4) that leaves no more."""
    step = F.floor(4 * F.log2("n")).cast("int")
    total, size, least = 0, 0, None
    sums = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("pretoken")).alias("b"))
    for r in sums.orderBy(F.desc("step")).collect():
        total, size = total + r["c"], size + r["b"]
        if total > limit or size > HOT_BYTES:
            break
        least = r["step"]
    if least is None:
        return {}
    kept = counted.where(step >= least).select("pretoken", "pieces").toArrow()
    return dict(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True))


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None, limit: int = 1024,
    hot: int = HOT,
) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit). `file` is a byte-level tokenizer file that splits by
    `vocabulary.PATTERN`."""
    file = file or vocabulary.path("byte_bpe_50k.json")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = written(piece_counts(distinct_pretokens(texts, file), file), "pretokens")
    common = docs.sparkSession.sparkContext.broadcast(_hot(counted, hot))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document with what the common pre-tokens give, and a row per
        document and other pre-token. `join` of a document's row names no pre-token."""
        pieces, specials = common.value, _specials(file)
        task = TaskContext.get().partitionId() << 40

        def weigh(span: str) -> tuple[int, list[str] | None]:
            tokens = vocabulary.pretokens(span, file)
            rare = [t for t in tokens if t not in pieces]
            return sum(pieces.get(t, 0) for t in tokens), rare or None

        memo, at = Memo(weigh, _PART_SPANS), 0
        names = ["row", "key", "n_bytes", "join", "n", "known"]
        for batch in batches:
            row, keys, n_bytes, join, n, known = [], [], [], [], [], []
            for key_, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts, total = _segments(value or "", specials)
                rare: Counter = Counter()
                for part in parts:
                    for span, times in Counter(vocabulary.spans(part)).items():
                        fixed, others = memo[span]
                        total += fixed * times
                        if others:
                            for t in others:
                                rare[t] += times
                at += 1
                row += [task + at] * (1 + len(rare))
                keys += [key_.as_py()] + [None] * len(rare)
                n_bytes += [len((value or "").encode())] + [None] * len(rare)
                join += [f"d{task + at}", *("t" + t for t in rare)]
                n += [0, *rare.values()]
                known += [total] + [0] * len(rare)
            arrays = [pa.array(x, t) for x, t in zip(
                (row, keys, n_bytes, join, n, known),
                (pa.int64(), batch.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = texts.schema["key"].dataType.simpleString()
    parts = arrow_map(texts, frequencies, f"row long, key {kind}, n_bytes long, join string, n long, known long")
    rest = counted.select(F.concat(F.lit("t"), "pretoken").alias("join"), "pieces")
    joined = parts.join(rest, "join", "left")
    return joined.groupBy("row").agg(
        F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"),
    ).select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
