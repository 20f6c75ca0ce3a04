"""Byte-level BPE by a dynamic program over byte prefixes.

Of all tokens a prefix ends with, exactly one can be the last token of the
prefix's encoding: the one that forms a valid pair with the last token of the
prefix before it. The table of these last tokens is the whole encoding of every
prefix: reading it backwards gives the ids, appending bytes only adds entries,
and after an edit only entries from the edited bytes on are made again, until
they agree with the old ones over a whole token length.

A pair of tokens is valid when no merge across their border would have been done
before the merges that made the two, which unmerging both step by step shows.

Texts are split by PATTERN first and every match is encoded by itself. A null or
empty text has no ids. Ranks must be a merge order, as in the rank files here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from siftline.llm import vocabulary
from siftline.llm.common import Memo, arrow_map

_MEMO, _PAIRS = 1 << 18, 1 << 20


class Encoder:
    """Encoding and decoding by one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Per token the two tokens of its last merge; a single byte has none.
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        #: Tokens by their bytes from the last to the first; -1 marks a whole one.
        self.endings: dict = {}
        for b, i in ranks.items():
            node = self.endings
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[-1] = i
        for i, b in sorted(self.bytes_of.items()):
            last = self.prefix_table(b, below=i) if len(b) > 1 else None
            self.split[i] = None
            if last is not None:
                right = last[-1]
                left = last[len(b) - len(self.bytes_of[right]) - 1]
                if len(self.bytes_of[left]) + len(self.bytes_of[right]) == len(b):
                    self.split[i] = (left, right)
                    self.pairs[left, right] = i
            self.known.clear()  # pairs may be no longer valid beside the new token

    def _valid(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' last merges, on the side of the border,
        and see that no merge over the border comes before what was undone."""
        bound = 1 << 60
        while True:
            if self.pairs.get((left, right), bound) < bound:
                return False
            of_left, of_right = self.split[left], self.split[right]
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                bound, left = left, of_left[1]
            else:
                # Of equal merges the left one is done first.
                bound, right = right + 1, of_right[0]

    def prefix_table(self, data: bytes, last: list[int] | None = None, below: int = 1 << 60) -> list[int]:
        """The last token of every prefix of `data`; `last` holds the first ones
        already. Only tokens ranked before `below` are used."""
        endings, known = self.endings, self.known
        last = [] if last is None else last
        for end in range(len(last), len(data)):
            node, at = endings, end
            while True:
                node = node.get(data[at])
                if node is None:
                    raise ValueError(f"byte {data[end]} has no token")
                token = node.get(-1)
                if token is not None and token < below:
                    if at == 0:
                        break
                    pair = last[at - 1] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= _PAIRS:
                            known.clear()
                        fits = known[pair] = self._valid(last[at - 1], token)
                    if fits:
                        break
                if at == 0:
                    raise ValueError(f"byte {data[end]} has no token")
                at -= 1
            last.append(token)
        return last

    def ids(self, data: bytes) -> list[int]:
        return self.read(self.prefix_table(data))

    def read(self, last: list[int]) -> list[int]:
        """The ids of the whole, from its table."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableText:
    """A byte string with its table, for appends and edits of one pre-token."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.prefix_table(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.prefix_table(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts `data` for the bytes from `start` to `end`; returns how many
        entries were made again. An entry depends on the bytes and entries of one
        token length before it, so the old ones hold again after as many agree."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, agree, at = old[:start], 0, start
        while at < len(self.data):
            self.encoder.prefix_table(self.data[: at + 1], self.last)
            at += 1
            if at > start + len(data):
                agree = agree + 1 if self.last[-1] == old[at - 1 - shift] else 0
                if agree >= self.encoder.longest:
                    self.last += old[at - shift:]
                    break
        return at - start

    def ids(self) -> list[int]:
        return self.encoder.read(self.last)


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(vocabulary.ranks(file))


def encode(docs: DataFrame, text: str = "text", file: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of `docs` and `ids`, the token ids of the text (null: none); a column
    of that name is replaced. Repeated rows are kept."""
    file = file or vocabulary.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _span_ids(file)
        for batch in batches:
            made = [list(chain.from_iterable(map(memo.__getitem__, vocabulary.spans(t or "")))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["row", "made"])

    # The row travels as one column, so no name of its own can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    schema = StructType([rows.schema["row"], StructField("made", ArrayType(IntegerType()))])
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != ids]
    return arrow_map(rows, run, schema, rows=64).select(*kept, F.col("made").alias(ids))


@lru_cache(maxsize=1)
def _span_ids(file: str) -> Memo:
    coder = encoder(file)
    tokens = Memo(lambda t: tuple(coder.ids(t.encode())), _MEMO)
    return Memo(lambda s: tuple(chain.from_iterable(tokens[t] for t in vocabulary.pretokens(s))), _MEMO)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256 (of the decimal ids joined
    by spaces), decoded_sha256 (of the bytes the ids decode to)."""
    file = file or vocabulary.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, coder = _span_ids(file), encoder(file)
        digits = {i: str(i) for i in coder.bytes_of}
        for batch in batches:
            n, ids_sha, bytes_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = list(chain.from_iterable(map(memo.__getitem__, vocabulary.spans(t or ""))))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run,
                     f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
