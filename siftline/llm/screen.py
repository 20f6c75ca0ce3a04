"""Rows that may be asked for, by a bitmap of bounded size: what is surely not wanted
stays where it is, and only the rest is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import arrow_map
from siftline.llm.words import mixed

MOST_BITS, MOST_PROBES = 27, 4


def bitmap(hashes: DataFrame):
    """Bits for the cells of every 64-bit value, and how many a value has, as a broadcast;
    tasks hand out the blocks that they set. Sixteen bits of room a value, 2^27 at most; the
    fuller they are, the fewer a value sets."""
    n = hashes.count()
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    size, probes = min(1 << bits, 1 << 19), max(1, min(MOST_PROBES, round(0.7 * (1 << bits) / max(n, 1))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _bits_of(batch.column(0).to_numpy(), bits, probes):
                cells[at] = True
        blocks = cells.reshape(-1, size)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pylist([{"block": i, "set": np.packbits(blocks[i]).tobytes()}], kind)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for i, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"block": at, "set": held.tobytes()}], kind)
                    at, held = i, np.zeros(size // 8, np.uint8)
                held |= np.frombuffer(some, np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"block": at, "set": held.tobytes()}], kind)

    kind = pa.schema([("block", pa.int32()), ("set", pa.binary())])
    parts = arrow_map(hashes, mark, "block int, set binary", rows=1 << 14).repartition("block").sortWithinPartitions("block")
    whole = np.zeros(((1 << bits) // size, size // 8), np.uint8)
    for r in arrow_map(parts, either, "block int, set binary", rows=16).collect():  # 2^bits bits
        whole[r["block"]] = np.frombuffer(r["set"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast((whole.reshape(-1), probes))


def _bits_of(hashes: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    # Some values come in the order of `mixed`, so their bits need another one.
    at = mixed(mixed(hashes.view(np.uint64)) + np.uint64(1))
    step = mixed(at + np.uint64(2)) | np.uint64(1)
    for _ in range(probes):
        yield (at >> np.uint64(64 - bits)).astype(np.int64)
        at = at + step


def marked(held: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    bits, probes = held
    out = np.ones(len(hashes), bool)
    for at in _bits_of(hashes, (8 * len(bits)).bit_length() - 1, probes):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def may_be_among(key: Column, keys: DataFrame) -> Column:
    """Whether `key` may be among `keys` (one column, of its type); never for null. Only
    hashes go to Python."""
    bits = bitmap(keys.select(F.xxhash64(keys.columns[0]).alias("hash")))

    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(marked(bits.value, hashes.to_numpy(zero_copy_only=False)))

    return key.isNotNull() & F.arrow_udf(run, "boolean")(F.xxhash64(key))


def asked_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `texts` (key, text) whose key may be among `keys` (key)."""
    kind = texts.schema["key"].dataType.simpleString()
    bits = bitmap(keys.select(F.xxhash64("key").alias("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[1:], ["key", "text"]).filter(pa.array(marked(bits.value, batch.column(0).to_numpy())))

    hashed = texts.where("key is not null").select(F.xxhash64("key").alias("hash"), "key", "text")
    # Texts go both ways here: small batches, or the buffers outside the heap grow.
    return arrow_map(hashed, run, f"key {kind}, text string", rows=64)
