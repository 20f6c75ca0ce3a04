"""Canonical length-limited Huffman codes over token ids, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: A checkpoint (bit offset) stands at every so many ids of a block.
STRIDE = 64


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """The length of every id's code (0: id does not occur), at most `limit` bits
    (more where there are too many ids for it), of the least total length. Coins
    of halving size are packaged in pairs, `limit` times; each time an id stands
    among the taken coins adds a bit to its code."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n <= 1:
        lengths[ids] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        coins = np.concatenate([leaves, packages])
        by_weight = np.argsort(coins, kind="stable")
        levels.append(by_weight < n)
        coins = coins[by_weight]
        packages = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
    depth, taken = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:taken].sum())
        depth[:n_leaves] += 1  # leaves are taken from the lightest on
        taken = 2 * (taken - n_leaves)
    lengths[order] = depth
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.width = max(1, int(lengths.max(initial=0)))
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        room = 1 << (self.width - lengths[ids].astype(np.int64))
        first = np.cumsum(room) - room  # code, filled up to `width` bits
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[ids] = first >> (self.width - lengths[ids].astype(np.int64))
        #: What the next `width` bits begin with.
        self.ids_at = np.zeros(1 << self.width, np.uint32)
        self.ids_at[: int(room.sum())] = np.repeat(ids, room)
        self.bits_at = self.lengths[self.ids_at]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STRIDE-th id."""
        (bits,), (offsets,) = self.encode_all(ids, np.array([len(ids)]))
        return bits, offsets

    def encode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """The same for many sequences, whose ids stand one behind the other."""
        bits = self.lengths[ids].astype(np.int64)
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits)])
        last = np.cumsum(counts)
        first = last - counts
        size = (sums[last] - sums[first] + 7) // 8
        at = np.cumsum(size) - size  # every sequence begins at a whole byte
        starts = sums[:-1] + np.repeat(at * 8 - sums[first], counts)
        # A code lies in one 32-bit word or ends in the next; words add up without carry.
        word, shift = starts >> 5, 64 - (starts & 31) - bits
        value = self.codes[ids].astype(np.uint64) << shift.astype(np.uint64)
        n = (int(size.sum()) + 3) // 4 + 1
        words = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
        words[1:] += np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: n - 1]
        data = words.astype(np.uint32).astype(">u4").tobytes()
        own = (starts - np.repeat(at * 8, counts)).astype(np.uint32)
        return ([data[a: a + s] for a, s in zip(at.tolist(), size.tolist(), strict=True)],
                [own[a:b:STRIDE] for a, b in zip(first.tolist(), last.tolist(), strict=True)])

    def decode(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The `n` ids; all stretches between checkpoints advance side by side."""
        padded = np.frombuffer(data + bytes(self.width * STRIDE // 8 + 8), np.uint8).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        at, out = offsets.astype(np.int64), np.empty((len(offsets), STRIDE), np.uint32)
        top, mask = 32 - self.width, (1 << self.width) - 1
        for k in range(min(STRIDE, n)):
            found = (window[at >> 3] >> (top - (at & 7)).astype(np.uint32)) & np.uint32(mask)
            out[:, k] = self.ids_at[found]
            at += self.bits_at[found]
        return out.reshape(-1)[:n]
