"""Tokens of a byte-level tokenizer, as places in the text's bytes: a text is encoded once, and windows of it are slices.

A tokenizer is a file of ranks (a base64 token and its number a line) and the pattern of its pieces; path is the same on every machine.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a byte-level tokenizer cuts a text into pieces, within which it merges bytes.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at a time.
STRETCH = 100_000
#: A blank between two letters: no piece holds a letter and a blank behind it, so one begins there, whatever is before.
_BOUND = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")


@lru_cache(2)
def _tokenizer(path: str, pattern: str):
    """The encoding and the bytes of each token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_bounds(path: str, text: str, pattern: str = PIECES, stretch: int = STRETCH) -> np.ndarray:
    """The byte before each token, and the end: one number more than there are tokens. Long texts are encoded in stretches, with the same result."""
    encoding, lengths = _tokenizer(path, pattern)
    parts, start = [np.zeros(1, np.int64)], 0
    while start < len(text):
        cut = _BOUND.search(text, start + stretch) if start + stretch < len(text) else None
        end = cut.start() if cut else len(text)
        parts.append(lengths[encoding.encode_ordinary(text[start:end])])
        start = end
    return np.cumsum(np.concatenate(parts))


def _over_texts(path: str, pattern: str, stretch: int, kind: str, value: Callable[[np.ndarray], object], arrow: pa.DataType) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def of(text: pa.Array) -> pa.Array:
        return pa.array([value(token_bounds(path, x.as_py() or "", pattern, stretch)) for x in text], arrow)

    return of


def count_tokens(path: str, text: Column, pattern: str = PIECES, stretch: int = STRETCH) -> Column:
    """0 for no text."""
    return _over_texts(path, pattern, stretch, "long", lambda b: len(b) - 1, pa.int64())(text)


def window_places(path: str, text: Column, max_tokens: int, overlap: int, pattern: str = PIECES, stretch: int = STRETCH) -> Column:
    """array of (first, bytes, tokens): windows of max_tokens that start every max_tokens - overlap, up to the first that reaches the end, by the byte (from 1) at which each begins. Empty for no text."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("0 <= overlap < max_tokens")

    def places(bounds: np.ndarray) -> list[dict]:
        n, out, start = len(bounds) - 1, [], 0
        while start < n:
            end = min(start + max_tokens, n)
            out.append({"first": int(bounds[start]) + 1, "bytes": int(bounds[end] - bounds[start]), "tokens": end - start})
            if end == n:
                break
            start = end - overlap
        return out

    kind = pa.list_(pa.struct([("first", pa.int32()), ("bytes", pa.int32()), ("tokens", pa.int32())]))
    return _over_texts(path, pattern, stretch, "array<struct<first:int,bytes:int,tokens:int>>", places, kind)(text)


def bytes_before_last(path: str, text: Column, n: int, pattern: str = PIECES, stretch: int = STRETCH) -> Column:
    """The bytes before the last n tokens; 0 if there are no more."""
    return _over_texts(path, pattern, stretch, "int", lambda b: int(b[max(0, len(b) - 1 - n)]), pa.int32())(text)


def decoded(text: Column, first: Column, n: Column) -> Column:
    """The text of n bytes from `first` (from 1). A character that a bound cuts is replaced, as in decoding tokens."""
    return F.make_valid_utf8(F.substring(text.cast("binary"), first, n).cast("string"))
