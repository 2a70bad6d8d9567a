"""MurmurHash3 (x86, 32 bits) of UTF-8 strings, vectorised over a batch: the standard function, unlike Spark's hash()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

C1, C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(texts: list[str], seed: int = 0) -> np.ndarray:
    """Unsigned values as int64."""
    data = [t.encode() for t in texts]
    length = np.array([len(d) for d in data], np.int64)
    width = -(-int(length.max(initial=0)) // 4) * 4
    block = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(len(data), width).copy()
    words = block.view("<u4").reshape(len(data), width // 4)
    h = np.full(len(data), seed, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(width // 4):
            k = _rotate(words[:, i] * C1, 15) * C2
            full, tail = length >= 4 * i + 4, (length > 4 * i) & (length < 4 * i + 4)
            h = np.where(full, _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(tail, h ^ k, h))
        h = h ^ length.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
    return h.astype(np.int64)


def term_indexes(terms: DataFrame, term: str = "term", seed: int = 0) -> DataFrame:
    """(term, index) of distinct terms."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(murmur3(batch.column(0).to_pylist(), seed), pa.int64())], ["term", "index"])

    return terms.select(term).where(f"{term} IS NOT NULL").distinct().mapInArrow(apply, "term string, index long")
