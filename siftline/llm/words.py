"""Words of many texts at once, as 64-bit hashes, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Some arrays are eight times as long, and a worker keeps what it once needed.
_PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OF_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers.of(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts, ends


@dataclass
class Words:
    """Of all texts: word hashes, byte spans in `data`, and the first word of
    every text (one more entry at the end)."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Hashes depend on a word's bytes alone. Texts are taken in pieces that end
    at white space, so memory stays a small multiple of the texts'."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            spaces = np.flatnonzero(_SPACE[raw[end: end + _PIECE]])
            end = end + int(spaces[0]) if len(spaces) else min(len(raw), end + _PIECE)
        h, s, e = _piece_words(raw[at:end])
        found.append((h, s + at, e + at))
        at = end
    hashes, starts, ends = (
        np.concatenate(x) if found else np.zeros(0, t)
        for x, t in zip(zip(*found) if found else [()] * 3, (np.uint64, np.int64, np.int64), strict=True))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))


def runs(texts: list[bytes | None], size: int = _PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `size` bytes, with the place of the first."""
    held: list[bytes] = []
    total = first = 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        total += len(held[-1])
        if total >= size:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every `k` consecutive words (fewer words: of the whole, once)."""
    n = min(k, len(hashes))
    if n == 0:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i: len(hashes) - n + 1 + i]
    return mixed(out)
