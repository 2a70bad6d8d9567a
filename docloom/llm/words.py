"""Words of many texts at once: their places in the bytes and 64-bit hashes, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 20

#: Bytes of words parted by white space, and of words of letters, digits and everything beyond ASCII (after lower-casing).
NOT_SPACE = np.array([b not in b"\t\n\x0b\x0c\r " for b in range(256)])
ALPHANUMERIC = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 for b in range(256)])

_random = np.random.Generator(np.random.PCG64(20))
BYTE = _random.integers(1, 2**64, 256, dtype=U)
BASE = int(_random.integers(2**62, 2**63)) | 1
PLACE = _random.integers(1, 2**64, 64, dtype=U) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits by which near numbers fall far apart."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes with A-Z lowered, offsets) for runs of rows of about `most` bytes; a longer text is a run of its own. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, first = column.buffers()[2], 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, len(column))
        part = data[int(offsets[first]) : int(offsets[end])].to_pybytes() if data is not None else b""
        yield first, np.frombuffer(part.lower(), np.uint8), offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Finds the words of a run of texts. starts, ends: bytes; text: the text's number in the run; hash: of the word."""

    def __init__(self, word_bytes: np.ndarray = NOT_SPACE):
        self.word_bytes, self.powers, self.inverse = word_bytes, np.ones(1, U), np.ones(1, U)

    def _grow(self, n: int) -> None:
        if n >= len(self.powers):
            n = max(n + 1, BATCH_BYTES)
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 2**64))):
                steps = np.full(n, U(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, U)
        self._grow(n)
        inside = self.word_bytes[data]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:], before[cuts] = False, inside[:-1], False
        after[-1], after[:-1], after[cuts - 1] = False, inside[1:], False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * self.powers[:n], out=sums[1:])
        return starts, ends, text, mixed((sums[ends] - sums[starts]) * self.inverse[starts])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by the first word's place."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, U(k * int(GOLDEN) % 2**64))
    for i in range(k):
        out += words[i : i + n] * (PLACE[i % 64] + U(i))
    return mixed(out)
