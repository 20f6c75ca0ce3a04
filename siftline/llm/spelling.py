"""Spelling variants: words at edit distance one, joined by asymmetric q-chunks.

* Counting: maximal letter runs of whole texts, A-Z lower-cased. Tasks count in a
  bounded table and hand out partial counts, which a combined shuffle adds up.
* Chunks and grams: of two words the shorter, of length m, gives its two disjoint
  chunks, `[0, m/2)` and `[m/2, m)`; the other (as long, or longer by one) gives its
  positional grams of the same sizes. One edit leaves one chunk whole, at its place or
  shifted by one. Of all positional grams only those within that shift can meet a
  chunk, so only these are made: four for each word, whatever its length.
* Crowded chunks: where a chunk meets more than `CROWD` pairs of words, nothing is
  compared. The two remainders again hold exactly one edit, so the shorter's is
  again cut into two chunks, down to one code point. So a bucket stays small although
  very many words share a beginning or an end, and no pair is lost.
* Verification: the two words' edit distance. The first code point at which they
  differ lies in the remainder of one chunk alone, so each pair comes out once.
* Form: a word's most frequent near word, if that is at least twice as frequent.
  Forms at least double the frequency, so they make no circles; roots are found by
  doubling the links.

Null texts have no words. A null key takes no code point out of its words (see
`word_counts`). Repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import arrow_map, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Pairs of words that one chunk may bring together; distinct words a task holds.
CROWD, HELD_WORDS, _PIECE = 1 << 10, 1 << 18, 1 << 20


def _runs(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text, in pieces that end where a run ends."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text) and (over := pattern.match(text, end)):
            end = over.end()
        yield pattern.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None, least_length: int = 5,
                least_count: int = 3) -> DataFrame:
    """(word, n) of all letter runs of `least_length` code points that occur
    `least_count` times. `damage`: where it divides h, the crc32 of "<key>:<run>", the
    run loses its code point h % length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(LETTERS), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{k}:".encode())
                # Bytes know of no letters but ASCII ones.
                for words in _runs((t or "").encode().lower().decode(), pattern):
                    for w in words:
                        if len(w) < least_length:
                            continue
                        if damage and k is not None and (h := zlib.crc32(w.encode(), start)) % damage == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < least_length:
                                continue
                        held[w] = held.get(w, 0) + 1
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(picked, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cut(rows: DataFrame) -> DataFrame:
    """Both chunks of every row's remainder: rows (key, gram, shift, lo, hi, word, n)
    stand for `word` outside [lo, hi + shift), which `key` fixes; lo and hi count in the
    shorter word."""
    half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")

    def chunk(side: int, at: Column, size: Column, lo: Column, hi: Column) -> Column:
        fixed = F.xxhash64("key", F.lit(side), F.substr("word", at + 1, size))
        return F.struct(fixed.alias("key"), "gram", "shift", lo.alias("lo"), hi.alias("hi"), "word", "n")

    lo, hi = F.col("lo"), F.col("hi")
    return rows.select(F.inline(F.array(
        chunk(0, lo, half, lo + half, hi), chunk(1, lo + half + F.col("shift"), hi - lo - half, lo, lo + half))))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of words that differ by one edit, a the shorter or, of
    equally long ones, the smaller."""
    x = rows.where(~F.col("gram")).select("key", "lo", "hi", F.col("word").alias("a"), F.col("n").alias("na"))
    y = rows.where("gram").select("key", "shift", F.col("word").alias("b"), F.col("n").alias("nb"))
    open_ = F.col("hi") - F.col("lo")
    same = lambda at, size: F.substr("a", at, size) == F.substr("b", at, size)
    return x.join(y, "key").where(
        ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & same(F.lit(1), F.col("lo"))
        & ((F.col("hi") == F.char_length("a")) | ~same(F.col("lo") + 1, open_))
        & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, na, b, nb) of `words` (word, n; distinct) at edit distance one."""
    m = F.char_length("word")

    def role(gram: bool, shift: int) -> Column:
        return F.struct(F.xxhash64(m - shift).alias("key"), F.lit(gram).alias("gram"), F.lit(shift).alias("shift"),
                        F.lit(0).alias("lo"), (m - shift).alias("hi"), "word", "n")

    rows = words.select(F.inline(F.array(role(False, 0), role(True, 0), role(True, 1))))
    pairs, level = None, 0
    while True:
        rows = written(_cut(rows), f"chunks-{level}")
        crowded = written(rows.groupBy("key").agg(
            F.sum((~F.col("gram")).cast("long")).alias("x"), F.sum(F.col("gram").cast("long")).alias("y"), F.max(F.col("hi") - F.col("lo")).alias("open")
        ).where((F.col("x") * F.col("y") > crowd) & (F.col("open") > 1)).select("key"), f"crowded-{level}")
        found = written(_met(rows.join(crowded, "key", "left_anti")), f"near-{level}")
        pairs = found if pairs is None else pairs.unionByName(found)
        if crowded.isEmpty():
            return pairs
        rows, level = rows.join(crowded, "key", "left_semi"), level + 1


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form)."""
    up = written(forms.select("word", F.col("form").alias("up")), "forms")
    n = up.count()
    while True:
        above = up.select(F.col("word").alias("up"), F.col("up").alias("further"))
        jumped = written(up.join(above, "up", "left").select(
            "word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "forms", n)
        up = jumped.select("word", "up")
        if jumped.where("moved").isEmpty():
            return up.withColumnRenamed("up", "root")


def variants(words: DataFrame, times: int = 2, crowd: int = CROWD) -> DataFrame:
    """Of every row of `words` (word, n; distinct): word, n, n_near, form (its near
    word of largest n, ties to the smallest, if that n is at least `times` its own),
    form_n, root (the last form; itself if none)."""
    pairs = near_words(words, crowd)
    sides = pairs.select("a", "b", "nb").union(pairs.select("b", "a", "na")).toDF("word", "other", "m")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= times * F.col("n")
    told = written(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "variants")
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None, least_length: int = 5,
                      least_count: int = 3, times: int = 2) -> DataFrame:
    """`variants` of the words of all texts."""
    return variants(written(word_counts(docs, key, text, damage, least_length, least_count), "words"), times)
