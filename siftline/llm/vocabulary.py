"""Public tokenizer files and the pre-tokens of a text, inside tasks."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

PATTERN = public_tokenizers.PATTERN
_BEFORE_WORD = re.compile(r" (?=\S)")
_MATCHES = regex.compile(PATTERN)


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(file)


@lru_cache(maxsize=4)
def ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def spans(text: str) -> list[str]:
    """`text` cut before every space that a non-space follows. A match of PATTERN
    never crosses such a cut and is found in its span as in the whole text, so
    spans can be looked up instead of matched."""
    first, *rest = _BEFORE_WORD.split(text)
    return [first, *(" " + r for r in rest)] if first else [" " + r for r in rest]


def pretokens(span: str, file: str | None = None) -> list[str]:
    """The matches of PATTERN. Libraries know different versions of Unicode; with
    a tokenizer file, letters beyond the Latin, Greek and Cyrillic blocks, where
    versions differ, are left to its library's own splitting."""
    if file and not span.isascii() and max(span) >= "\u0530":
        return [span[a:b] for _, (a, b) in tokenizer(file).pre_tokenizer.pre_tokenize_str(span)]
    return _MATCHES.findall(span)
