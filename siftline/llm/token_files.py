"""Token ids as files of canonical, length-limited Huffman codes.

A file set is three Parquet tables below one path, so that Spark's writers commit
them and any store will do:

* `code`: id and code length of the canonical code made from the global counts;
* `blocks`: independent blocks in document order. A block holds whole documents
  (their keys and numbers of ids), the place of its first id in the whole set, the
  bits, and the bit offset of every 64th id, so a reader can start at any of them;
* `ids`: the counts of ids, from which the code was made.

Ids are made once, by the tokenizer library, and kept as a compressed table in
the shared folder until the global counts are known; only code bits are shuffled.
Documents are ordered by their numeric key, null keys last by a hash of their text, rows of one
key by that hash. A null or empty text holds the end id alone.

Two stretches of a text with ASCII white space between them are encoded
independently by the word tokenizer (its normalizer and its splitting never look
across white space), so a stretch is given to the library once per worker.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import vocabulary
from siftline.llm.common import Memo, arrow_map
from siftline.llm.huffman import STRIDE, Code, code_lengths
from siftline.llm.words import runs, words_of
from siftline.session import shared_folder

BLOCK_IDS = 1 << 16
_MEMO, _RUN = 800_000, 4 << 20
#: A Latin word (not normalized further, one match of the splitting pattern) and
#: the marks behind it (another).
_WORD_AND_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


@lru_cache(maxsize=1)
def _stretches(file: str) -> Memo:
    t = vocabulary.tokenizer(file)
    specials = tuple(s.content for s in t.get_added_tokens_decoder().values())
    #: What the pre-tokenizer makes of a letter's bytes.
    as_bytes = {i: t.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in (*range(97, 123), *range(0xDF, 0x100)) if chr(i).isalpha()}

    def pack(ids: list[int]) -> bytes:
        return array("H", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u2").tobytes()

    # Straight to the library's merges: its other steps are known for such words.
    latin = Memo(lambda word: pack([x.id for x in t.model.tokenize(word if word.isascii() else word.translate(as_bytes))]), _MEMO // 2)

    def make(stretch: bytes) -> bytes:
        text = stretch.decode()
        parts = _WORD_AND_MARKS.fullmatch(text)
        if parts and not any(s in text for s in specials):
            word, marks = parts.groups()
            return latin[word.lower()] + memo[marks.encode()] if marks else latin[word.lower()]
        return pack(t.encode(text, add_special_tokens=False).ids)

    memo = Memo(make, _MEMO)
    return memo


def _batch_ids(memo: Memo, texts: list[str | None]) -> list[bytes]:
    """Every text's ids. The stretches of many texts are told apart by their
    hashes, and each different one is looked up once for all of them."""
    out = []
    for _, some in runs([(t or "").encode() for t in texts], _RUN):
        w = words_of(some)
        _, sample, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        made = [memo[w.data[a:b]] for a, b in zip(w.starts[sample].tolist(), w.ends[sample].tolist(), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 2
        ids = np.frombuffer(b"".join(made), "<u2")
        n = sizes[which]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([[0], ends])[w.first] * 2
        data = ids[place].tobytes()
        out += [data[a:b] for a, b in pairwise(bounds.tolist())]
    return out


def _encoded(docs: DataFrame, key: str, text: str, file: str, end_id: int) -> DataFrame:
    """key, hash of the text, n, ids (little-endian, two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = _stretches(file), int(end_id).to_bytes(2, "little")
        for batch in batches:
            made = [m + end for m in _batch_ids(memo, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(m) // 2 for m in made], pa.int64()), pa.array(made, pa.binary())],
                ["key", "hash", "n", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    return arrow_map(picked, run, f"key {kind}, hash long, n long, ids binary", rows=2048)


def _global_counts(ids: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id: summed per task, then over at most `size` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in arrow_map(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", file: str | None = None, end_id: int = 1,
) -> None:
    """Encodes the texts, each followed by `end_id`, and writes the file set."""
    file = file or vocabulary.path("word_bpe_49k.json")
    spark, size = docs.sparkSession, vocabulary.tokenizer(file).get_vocab_size()
    if size > 1 << 16:
        raise ValueError("ids do not fit in two bytes")
    kept = shared_folder(spark, "ids")
    encoded = _encoded(docs, key, text, file, end_id)
    encoded.write.option("compression", "zstd").parquet(kept)
    ids = spark.read.schema(encoded.schema).parquet(kept)
    counts = _global_counts(ids, size)
    lengths = code_lengths(counts)
    spark.createDataFrame(
        [(int(i), int(counts[i]), int(lengths[i])) for i in np.flatnonzero(counts)], "id int, n long, bits int"
    ).coalesce(1).write.parquet(f"{path}/code")

    # Ranges of the key, then ranges of the hash for rows without a key.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.unique(ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts))

    def part_of(keys: pa.Array, hashes: pa.Array) -> np.ndarray:
        by_hash = (hashes.to_numpy().view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        none = np.asarray(keys.is_null())
        by_key = np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(none, by_hash.astype(np.int64) + parts, by_key)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * parts, np.int64)
        for batch in batches:
            np.add.at(total, part_of(batch.column(0), batch.column(1)), batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * parts), pa.int32()), pa.array(total)], ["part", "n"])

    totals = {r["part"]: r["n"] for r in arrow_map(ids.select("key", "hash", "n"), sums, "part int, n long", rows=8192)
              .groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, at = {}, 0
    for p in sorted(totals):
        starts[p], at = at, at + totals[p]
    code = spark.sparkContext.broadcast(Code(lengths))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = code.value.encode_all(
                np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2"), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_of(*batch.columns[:2]), pa.int32()), *batch.columns[:3], pa.array(data, pa.binary()),
                 pa.array([o.tobytes() for o in offsets], pa.binary())],
                ["part", "key", "hash", "n", "bits", "offsets"])

    kind = ids.schema["key"].dataType.simpleString()
    coded = arrow_map(ids.select("key", "hash", "n", "ids"), bits,
                      f"part int, key {kind}, hash long, n long, bits binary, offsets binary")
    ranged = coded.repartitionById(2 * parts, "part").sortWithinPartitions(
        "part", F.col("key").asc_nulls_last(), F.shiftrightunsigned("hash", 32), "hash")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "keys", "counts", "bits", "offsets"]
        key_type, current, at, held, total = None, None, 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal at, held, total
            row = pa.RecordBatch.from_arrays([
                pa.array([at], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(key_type)),
                pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                pa.array([[h[2] for h in held]], pa.list_(pa.binary())),
                pa.array([[h[3] for h in held]], pa.list_(pa.binary()))], names)
            at, held, total = at + total, [], 0
            return row

        for batch in batches:
            key_type = batch.schema.types[1]
            for p, k, n, b, o in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if held and (p != current or total >= BLOCK_IDS):
                    yield block()
                if p != current:
                    current, at = p, starts[p]
                held.append((k, n, b, o))
                total += n
        if held:
            yield block()

    arrow_map(ranged, assemble,
              f"start long, keys array<{kind}>, counts array<long>, bits array<binary>, offsets array<binary>", rows=256) \
        .write.option("compression", "none").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(f"{path}/code").select("id", "bits").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return Code(lengths)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document, from the files: key, start (ids of all documents
    before it), n_tokens, and the ids (or with `digest` their crc32 as
    little-endian unsigned 32-bit integers)."""
    code = spark.sparkContext.broadcast(read_code(spark, path))
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, counts, values = [], [], [], []
            for start, k, n, bits, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = _block_ids(code.value, n, bits, offsets)
                ends = np.cumsum(n)
                keys += k
                starts += (start + ends - n).tolist()
                counts += n
                values += [ids[e - c:e] for e, c in zip(ends.tolist(), n, strict=True)]
            made = pa.array([zlib.crc32(v.astype("<u4").tobytes()) for v in values], pa.int64()) if digest \
                else pa.array([v.tolist() for v in values], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.types[1].value_type), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int64()), made], ["key", "start", "n_tokens", last])

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "keys", "counts", "bits", "offsets")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    return arrow_map(blocks, run, f"key {kind}, start long, n_tokens long, {last} "
                     + ("long" if digest else "array<int>"), rows=16)


def _block_ids(code: Code, counts: list[int], bits: list[bytes], offsets: list[bytes]) -> np.ndarray:
    """All ids of a block. Every document's bits begin at a whole byte and its
    checkpoints count from there; the block's stretches advance together."""
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    first = (np.cumsum(sizes) - sizes) * 8
    marks = [np.frombuffer(o, np.uint32) for o in offsets]
    lanes = np.fromiter(map(len, marks), np.int64, len(marks))
    at = np.concatenate(marks).astype(np.int64) + np.repeat(first, lanes) if marks else np.zeros(0, np.int64)
    grid = code.decode(b"".join(bits), at, len(at) * STRIDE)
    n = np.asarray(counts, np.int64)
    # Only the last stretch of a document can be shorter than STRIDE.
    lane_ends = np.cumsum(lanes)
    held = np.full(len(at), STRIDE, np.int64)
    held[lane_ends - 1] = n - (lanes - 1) * STRIDE
    return grid.reshape(-1, STRIDE)[np.arange(STRIDE) < held[:, None]]
