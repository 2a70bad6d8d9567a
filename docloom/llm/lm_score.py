"""Scores of an interpolated modified Kneser-Ney n-gram model.

Counting. A first pass counts words and numbers them, frequent ones first. In a second one each task counts the n-grams of its texts
as numbers and sends blocks of distinct n-grams to shards. An n-gram's shard follows from its last word but one, of which all orders
above the first know it as (the end of) their context: a shard therefore has all n-grams that a context or a continuation count
needs, of every order above the second, in one shuffle. A word that is more frequent than a shard is large is dealt by the word before it
as well; of these words only, the pairs that begin with them are then summed in another shuffle. Words' own continuation counts are last.
A frequent n-gram comes as one entry a block, never as its occurrences.

Storing. The task that has merged a shard writes it as one file of sorted hash arrays: a directory by the first bits of a 64-bit hash,
the next 32 bits in order, and the counts beside them, one byte where that is enough. A file appears whole or not at all, and is the
same if a task is repeated.

Scoring. Workers map the files into memory; an n-gram is found by its shard, its directory entry and a binary search.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, scratch
from .words import PLACE, U, Words, mixed, text_slices

ORDER = 3
#: Words that a task holds before it sends its blocks (local numbers have 21 bits), and n-grams that a shard should have.
HELD, SHARD = 1 << 20, 1 << 20
#: Ranges that a block is sent to; more shards than these are reached in two shuffles.
RANGES = 4096
#: Files that a worker keeps mapped; before Python 3.13 each of them keeps a descriptor open.
MAPPED, UNTRACKED = (8192, {"trackfd": False}) if sys.version_info >= (3, 13) else (512, {})
END, START = U(0x1C80317FA3B1799D), U(0xBDD640FB06671AD1)
SALT = U(0x2545F4914F6CDD1D)
#: A word's class by its count: small numbers for frequent words, so that blocks are short.
CLASSES = np.array([4, 64, 4096])
UNKNOWN = U(2**63)


def _join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word."""
    return mixed(context * PLACE[3] + mixed(word + PLACE[4]))


def _hash(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), PLACE[5])
    for w in words:
        out = _join(out, w)
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash, by other bits than those that sort it within the part."""
    return ((mixed(h ^ SALT) >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _sequences(h: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with one END after each, and the text of each."""
    ends = np.searchsorted(doc, np.arange(texts), "right")
    return np.insert(h, ends, END), np.insert(doc, ends, np.arange(texts))


def _before(words: np.ndarray, doc: np.ndarray, steps: int, start: int) -> np.ndarray:
    """The word so many steps before each word of its text; start before the first."""
    out = np.full(len(words), start, words.dtype)
    if steps < len(words):
        same = doc[steps:] == doc[:-steps]
        out[steps:][same] = words[:-steps][same]
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _summed(hashes: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of equal hashes as one, by hash."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = _runs(hashes)
    return hashes[first], [k[order[first]] for k in keys], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]


def _times(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For runs of a context's n-grams: the sum of their counts, and how many have 1, 2, and 3 or more."""
    ones = [(value == i if i < 3 else value >= 3).astype(U) for i in (1, 2, 3)]
    return [np.add.reduceat(x, first) if len(first) else x[:0] for x in (value, *ones)]


# Blocks


def _pack(columns: list[np.ndarray], ordered: int) -> bytes:
    """Whole numbers byte by byte, so that equal high bytes stand together; the first columns, which are in order, as differences."""
    head, planes = [len(columns[0])], []
    for i, x in enumerate(columns):
        x = np.diff(x, prepend=U(0)) if i < ordered else x
        width = max(1, (int(x.max()).bit_length() + 7) // 8)
        head.append(width)
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, np.int64).tobytes() + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpack(data: bytes, columns: int, ordered: int) -> list[np.ndarray]:
    n, *widths = (int(x) for x in np.frombuffer(data[: 8 * columns + 8], np.int64))
    raw, at, out = np.frombuffer(pa.Codec("zstd").decompress(data[8 * columns + 8 :], n * sum(widths), asbytes=True), np.uint8), 0, []
    for i, width in enumerate(widths):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        at += n * width
        x = x.view(U).reshape(-1)
        out.append(np.cumsum(x, dtype=U) if i < ordered else x)
    return out


def _blocks(columns: list[np.ndarray], stride: int) -> Iterator[tuple[int, bytes]]:
    """(range, data) for columns that are in order by the first, the part; a range has `stride` parts."""
    of = columns[0] // U(stride)
    first = _runs(of)
    for a, b in zip(first, [*first[1:], len(of)]):
        yield int(of[a]), _pack([c[a:b] for c in columns], 2)


def _batches(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    for pair in pairs:
        held.append(pair)
        if len(held) == 64:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int32()), pa.array([d for _, d in held], pa.binary())], ["part", "data"])


def _to_parts(blocks: DataFrame, columns: int, stride: int) -> DataFrame:
    """Blocks by part from blocks by range."""
    if stride == 1:
        return blocks

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            together = [np.concatenate(c) for c in zip(*held)]
            order = np.lexsort((together[1], together[0]))
            yield from _batches(_blocks([c[order] for c in together], 1))

        for batch in batches:
            for data in batch.column(1):
                held.append(_unpack(data.as_py(), columns, 2))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return blocks.repartition("part").mapInArrow(split, "part int, data binary")


def _merged(blocks: pa.ChunkedArray, keys: int, counts: int, hashed: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """All blocks of a part as one, without the part itself; summed whenever so many rows are held that summing pays."""
    held, done, size = [], [], 0
    for i, data in enumerate(blocks):
        held.append(_unpack(data.as_py(), 1 + keys + counts, 2)[1:])
        size += len(held[-1][0])
        if i + 1 == len(blocks) or size > SHARD + (len(done[0]) if done else 0):
            columns = [np.concatenate(c) for c in zip(*([done] if done else []), *held)]
            hashes, k, c = _summed(hashed(columns[:keys]), columns[:keys], columns[keys:])
            done, held, size = [*k, *c], [], 0
    return hashes, done[:keys], done[keys:]


# Files


def local_path(folder: str) -> str:
    """The shared folder as workers open it. Every machine mounts it at one place; other stores need such a mount."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: model files are mapped into memory, so the shared folder must be a mounted path (file:/...)")
    return folder


def _narrow(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """One byte a number, with the few large ones apart; or as wide as the largest needs."""
    large = np.flatnonzero(x >= 255)
    if 12 * len(large) > len(x):
        return {name: x.astype(np.min_scalar_type(int(x.max())))}
    return {name: np.minimum(x, 255).astype(np.uint8), f"{name}+at": large.astype(np.uint32), f"{name}+": x[large]}


def _arrays(name: str, hashes: np.ndarray, columns: dict[str, np.ndarray], whole: bool = False) -> dict[str, np.ndarray]:
    """Of sorted hashes: the first row of each value of their first bits, about eight rows each, and the next 32 bits (or all)."""
    bits = max(1, (len(hashes) // 8).bit_length())
    starts = np.searchsorted(hashes >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    out = {f"{name}.starts": starts.astype(np.uint32), f"{name}.rest": hashes if whole else ((hashes << U(bits)) >> U(32)).astype(np.uint32)}
    for c, x in columns.items():
        out |= _narrow(f"{name}.{c}", x)
    return out


def _put(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A file of arrays, which appears whole or not at all, and again alike if a task is repeated."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
    with open(part, "wb") as f:
        f.write(np.array([len(text)], np.int64).tobytes() + text)
        for x in arrays.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(part, path)


class Arrays:
    """A file of arrays, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int(np.frombuffer(f.read(8), np.int64)[0])
            head = json.loads(f.read(size))
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
        self.of = {name: np.frombuffer(data, np.dtype(kind), n, 8 + size + at) if n else np.zeros(0, np.dtype(kind)) for name, (kind, n, at) in head.items()}

    def find(self, name: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash in table `name`, and whether it is there."""
        starts, rest = self.of[f"{name}.starts"], self.of[f"{name}.rest"]
        if not len(rest):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        bits = U((len(starts) - 1).bit_length() - 1)
        wanted = h if rest.dtype == U else ((h << bits) >> U(32)).astype(np.uint32)
        bucket = (h >> (U(64) - bits)).astype(np.int64)
        low, high = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
        end, last = high.copy(), len(rest) - 1
        while (low < high).any():
            middle = (low + high) >> 1
            less = (rest[np.minimum(middle, last)] < wanted) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        at = np.minimum(low, last)
        return at, (low < end) & (rest[at] == wanted)

    def column(self, name: str, at: np.ndarray) -> np.ndarray:
        x = self.of[name][at].astype(np.int64)
        if f"{name}+" in self.of:
            large = np.flatnonzero(x == 255)
            x[large] = self.of[f"{name}+"][np.searchsorted(self.of[f"{name}+at"], at[large])]
        return x


# Training


@dataclass
class Model:
    """Where the files are and what holds for the whole corpus. By order k, from 1: discounts[k]."""

    folder: str
    order: int
    shards: int
    ranges: int
    #: Words of higher counts are dealt with the word before them.
    hot: int
    tokens: int = 0
    words: int = 0
    #: The first number of each class (frequent ones first) and range of words.
    bases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discounts: dict[int, list[float]] = field(default_factory=dict)
    #: Of order 1: the sum of its counts, and the weight that they leave to words that training has not seen.
    total: float = 0.0
    rest: float = 1.0


def discounts(n: list[int]) -> list[float]:
    """For counts of 1, 2 and 3 or more, from how many n-grams have counts of 1 to 4; within [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(out)]


def _class(counts: np.ndarray) -> np.ndarray:
    return len(CLASSES) - np.searchsorted(CLASSES, counts, "right")


#: What a task that merges a part returns: blocks for the next ones (kind, part, data), and rows of statistics (kind s) of order k.
SCHEMA = "kind string, part int, data binary, k int, n1 long, n2 long, n3 long, n4 long, n long, value long"
KINDS = [pa.string(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 6]
NAMES = ["kind", "part", "data", "k", "n1", "n2", "n3", "n4", "n", "value"]


def _statistics(k: int, value: np.ndarray, part: int = 0) -> tuple:
    return ("s", part, None, k, *(int((value == i).sum()) for i in (1, 2, 3, 4)), int((value > 0).sum()), int(value.sum()))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)


def _merge_words(folder: str):
    """Words of a range with their counts, and their places among those of their class."""

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes, _, (counts,) = _merged(table.column("data"), 1, 1, lambda keys: keys[0])
        of, place, rows = _class(counts), np.zeros(len(counts), U), [_statistics(1, counts, part)]
        for c in range(len(CLASSES) + 1):
            mine = of == c
            place[mine] = np.arange(mine.sum())
            rows.append(("c", part, None, c, 0, 0, 0, 0, int(mine.sum()), 0))
        _put(f"{folder}/words-{part}", _arrays("w", hashes, {"count": counts, "place": place}, whole=True))
        return _table(rows)

    return merge


def _words_of_pairs(model: Model, last: np.ndarray, context: np.ndarray, value: np.ndarray, stride: int) -> Iterator[tuple]:
    """Blocks of what distinct pairs tell of their words: how many end in a word; and of those that begin with it, how many and with which counts."""
    order = np.argsort(context)
    first = _runs(context[order])
    ends, types = np.unique(last, return_counts=True)
    own = [context[order][first], *_times(value[order], first)]
    words = np.union1d(ends, own[0])
    columns = [np.zeros(len(words), U) for _ in range(5)]
    columns[0][np.searchsorted(words, ends)] = types
    for c, x in zip(columns[1:], own[1:]):
        c[np.searchsorted(words, own[0])] = x
    part = ((np.searchsorted(model.bases, words.astype(np.int64), "right") - 1) % model.ranges).astype(U)
    order = np.argsort(part, kind="stable")
    for r, data in _blocks([c[order] for c in (part, words, *columns)], stride):
        yield "u", r, data, *[None] * 7


def _merge_grams(model: Model, strides: tuple[int, int]):
    """A shard's n-grams from the highest order down to pairs; those pairs whose first word is dealt over all shards go on."""

    def merge(table: pa.Table) -> pa.Table:
        part, n, rows, arrays = table.column("part")[0].as_py(), model.order, [], {}
        # Columns: the last context word, whether it is frequent, the words before it from the nearest, the last word.
        hashes, keys, (value,) = _merged(table.column("data"), n + 1, 1, lambda keys: _hash(_in_text(keys)))
        for k in range(n, 2, -1):
            arrays |= _arrays(f"{k}", hashes, {"count": value})
            rows.append(_statistics(k, value))
            context = _hash(_in_text(keys)[:-1])
            order = np.argsort(context)
            first = _runs(context[order])
            arrays |= _arrays(f"{k}c", context[order[first]], dict(zip(("total", "n1", "n2", "n3"), _times(value[order], first))))
            keys = [*keys[: k - 1], keys[k]]
            hashes, keys, (value,) = _summed(_hash(_in_text(keys)), keys, [np.ones(len(hashes), U)])
        context, frequent, last = keys
        own = frequent == 0
        arrays |= _arrays("2", hashes[own], {"count": value[own]})
        _put(f"{model.folder}/shard-{part}", arrays)
        rows.append(_statistics(2, value[own]))
        rows += _words_of_pairs(model, last[own], context[own], value[own], strides[1])
        to = _part(hashes[~own], model.shards).astype(U)
        order = np.lexsort((context[~own], to))
        for r, data in _blocks([c[order] for c in (to, context[~own], last[~own], value[~own])], strides[0]):
            rows.append(("p", r, data, *[None] * 7))
        return _table(rows)

    return merge


def _in_text(keys: list[np.ndarray]) -> list[np.ndarray]:
    """An n-gram's words as they follow one another, from a block's columns."""
    return [*keys[2:-1][::-1], keys[0], keys[-1]]


def _merge_pairs(model: Model, stride: int):
    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes, (context, last), (value,) = _merged(table.column("data"), 2, 1, _hash)
        _put(f"{model.folder}/pairs-{part}", _arrays("2", hashes, {"count": value}))
        return _table([_statistics(2, value), *_words_of_pairs(model, last, context, value, stride)])

    return merge


def _merge_own(model: Model):
    """What all pairs tell of the words of a range, beside the words themselves."""

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, (words,), columns = _merged(table.column("data"), 1, 5, lambda keys: keys[0])
        words, file = words.astype(np.int64), Arrays(f"{model.folder}/words-{part}")
        every = np.arange(len(file.of["w.rest"]))
        # The row of each word, by its class and its place there.
        number = model.bases.reshape(-1, model.ranges)[_class(file.column("w.count", every)), part] + file.column("w.place", every)
        order = np.argsort(number)
        at, arrays = order[np.searchsorted(number, words, sorter=order)], {}
        for name, c in zip(("ends", "total", "n1", "n2", "n3"), columns):
            x = np.zeros(len(every), U)
            x[at] = c
            arrays |= _narrow(name, x)
        _put(f"{model.folder}/own-{part}", arrays)
        return _table([_statistics(1, columns[0])])

    return merge


def _count_words(ranges: int, stride: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, size = Words(), [], 0

        def send() -> Iterator[pa.RecordBatch]:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            # START is numbered as well, without any count.
            words, counts = np.append(words, START), np.append(counts, 0).astype(U)
            part = _part(words, ranges).astype(U)
            order = np.lexsort((words, part))
            yield from _batches(_blocks([part[order], words[order], counts[order]], stride))

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                held.append(_sequences(*scan(data, offsets)[3:1:-1], len(offsets) - 1)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return count


def _count_grams(model: Model, stride: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, reader, held, size, n = Words(), Reader(model), [], 0, model.order

        def send(words: np.ndarray, doc: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            distinct, local = np.unique(np.append(words, START), return_inverse=True)
            found = reader.words(distinct)
            number, frequent = found["number"], (found["count"] > model.hot).astype(U)
            # Local numbers in the order of the blocks: rare words by shard, then frequent ones.
            shard = _part(_hash([number]), model.shards)
            order = np.lexsort((number, shard, frequent))
            rank = np.empty(len(order), U)
            rank[order] = np.arange(len(order), dtype=U)
            number, frequent, shard, rank = number[order], frequent[order], shard[order], rank[local]
            start, rank = int(rank[-1]), rank[:-1]
            before = [_before(rank, doc, steps, start) for steps in range(1, n)]
            code = before[0]
            for x in before[1:]:  # contexts are numbered anew with every word, so that they always fit
                code = np.unique(code << U(21) | x, return_inverse=True)[1].astype(U)
            own = np.flatnonzero(own)
            _, first, times = np.unique((code << U(21) | rank)[own], return_index=True, return_counts=True)
            first = own[first]
            keys = [number[before[0][first]], frequent[before[0][first]], *(number[x[first]] for x in before[1:]), number[rank[first]]]
            times = times.astype(U)
            if n == 2:
                part = _part(_hash([keys[0], keys[-1]]), model.shards).astype(U)
                order = np.lexsort((keys[0], part))
                return _batches(_blocks([c[order] for c in (part, keys[0], keys[-1], times)], stride))
            part = shard[before[0][first]].astype(U)
            often = keys[1] == 1
            part[often] = _part(_hash([keys[2][often], keys[0][often]]), model.shards)
            order = np.argsort(part, kind="stable")
            return _batches(_blocks([c[order] for c in (part, *keys, times)], stride))

        texts = 0
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                words, doc = _sequences(*scan(data, offsets)[3:1:-1], len(offsets) - 1)
                for a in range(0, len(words), HELD // 2):  # a huge text in parts, each after the words that end the one before
                    some = slice(max(0, a - n + 1), a + HELD // 2)
                    if size and size + len(words[some]) > HELD:
                        yield from send(*(np.concatenate(x) for x in zip(*held)))
                        held, size = [], 0
                    held.append((words[some], doc[some] + texts, np.arange(some.start, some.start + len(words[some])) >= a))
                    size += len(words[some])
                texts += len(offsets)
        if held:
            yield from send(*(np.concatenate(x) for x in zip(*held)))

    return count


def train(docs: DataFrame, text: str = "text", order: int = ORDER, shard_rows: int = SHARD) -> Model:
    """Counts all rows of docs. Words are parted by white space, A-Z lowered, with one end after each text; null texts are empty.

    Texts of any length are read whole. An empty table gives a model of no words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards, ranges = max(1, -(-size // (6 * shard_rows))), max(1, -(-size // (64 * shard_rows)))
    model = Model(local_path(new_folder(spark, "kneser-ney")), order, shards, ranges, shard_rows)
    strides = tuple(-(-x // RANGES) for x in (shards, ranges))

    def reduced(blocks: DataFrame, columns: int, stride: int, merge, name: str) -> DataFrame:
        parts = _to_parts(blocks.select("part", "data"), columns, stride)
        return settle(parts.groupBy("part").applyInArrow(merge, SCHEMA), name, "uncompressed")

    def note(k: int, *tables: DataFrame) -> dict:
        counts = [t.where(f"kind = 's' AND k = {k}").agg(*(F.sum(c).alias(c) for c in NAMES[4:])).first().asDict() for t in tables]
        x = {c: sum(t[c] or 0 for t in counts) for c in NAMES[4:]}
        model.discounts[k] = discounts([x[f"n{i}"] for i in (1, 2, 3, 4)])
        return x

    with scratch(spark, "counts") as settle:
        words = reduced(rows.mapInArrow(_count_words(ranges, strides[1]), "part int, data binary"), 3, strides[1], _merge_words(model.folder), "words")
        x = note(1, words)
        model.tokens, model.words = x["value"], x["n"]
        sizes = np.zeros((len(CLASSES) + 1, ranges), np.int64)
        for part, c, n in words.where("kind = 'c'").select("part", "k", "n").collect():
            sizes[c, part] = n
        model.bases = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])[:-1]
        if model.tokens and order > 1:
            grams = rows.mapInArrow(_count_grams(model, strides[0]), "part int, data binary")
            if order == 2:
                above = [reduced(grams, 4, strides[0], _merge_pairs(model, strides[1]), "pairs")]
            else:
                shard = reduced(grams, order + 3, strides[0], _merge_grams(model, strides), "shards")
                above = [shard, reduced(shard.where("kind = 'p'"), 4, strides[0], _merge_pairs(model, strides[1]), "pairs")]
            for k in range(2, order + 1):
                note(k, *above)
            of_words = above[0].where("kind = 'u'")
            for t in above[1:]:
                of_words = of_words.unionByName(t.where("kind = 'u'"))
            x = note(1, reduced(of_words, 7, strides[1], _merge_own(model), "own"))
    model.total = float(x["value"])
    if model.total:
        d = model.discounts[1]
        model.rest = (d[0] * x["n1"] + d[1] * x["n2"] + d[2] * (model.words - x["n1"] - x["n2"])) / model.total
    return model


# Scoring


class Reader:
    """The model's files, mapped into memory when first needed."""

    def __init__(self, model: Model):
        self.model, self.files = model, OrderedDict()

    def file(self, name: str) -> Arrays | None:
        if name not in self.files:
            if len(self.files) >= MAPPED:
                self.files.popitem(last=False)
            path = f"{self.model.folder}/{name}"
            self.files[name] = Arrays(path) if os.path.exists(path) else None
        self.files.move_to_end(name)
        return self.files[name]

    def _by_part(self, name: str, part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, Arrays, int]]:
        """rows by part, with the part's file."""
        rows = rows[np.argsort(part[rows], kind="stable")]
        first = _runs(part[rows])
        for a, b in zip(first, [*first[1:], len(rows)]):
            p = int(part[rows[a]])
            if (file := self.file(f"{name}-{p}")) is not None:
                yield rows[a:b], file, p

    def words(self, h: np.ndarray, own: bool = False) -> dict[str, np.ndarray]:
        """Of distinct words: their numbers (UNKNOWN without one) and counts; if own, also what pairs tell of them."""
        m = self.model
        names = ("ends", "total", "n1", "n2", "n3") if own else ()
        out = {"number": np.full(len(h), UNKNOWN)} | {x: np.zeros(len(h), np.int64) for x in ("count", *names)}
        for rows, file, part in self._by_part("words", _part(h, m.ranges), np.arange(len(h))):
            at, found = file.find("w", h[rows])
            rows, at = rows[found], at[found]
            out["count"][rows] = file.column("w.count", at)
            out["number"][rows] = m.bases.reshape(-1, m.ranges)[_class(out["count"][rows]), part] + file.column("w.place", at)
            if names and (more := self.file(f"own-{part}")) is not None:
                for x in names:
                    out[x][rows] = more.column(x, at)
        return out

    def _discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return c - np.array([0.0, *self.model.discounts[k]])[np.minimum(c, 3)]

    def _left(self, k: int, times: list[np.ndarray]) -> np.ndarray:
        return sum(d * n for d, n in zip(self.model.discounts[k], times))

    def probabilities(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word after those before it in its text, and its plain count in training."""
        m = self.model
        distinct, local = np.unique(np.append(words, START), return_inverse=True)
        of = self.words(distinct, m.order > 1)
        start, local = local[-1], local[:-1]
        number, known = of["number"], (of["count"] > 0)[local]
        p = np.full(len(words), m.rest / (m.words + 1))
        if not m.total:
            return p, of["count"][local]
        p[known] += (self._discounted(1, of["ends" if m.order > 1 else "count"]) / m.total)[local[known]]
        before = [_before(local, doc, steps, start) for steps in range(1, m.order)]
        if before:
            context = before[0]
            total = of["total"][context].astype(float)
            rows = np.flatnonzero(total)
            lower = p[rows] * self._left(2, [of[x][context[rows]] for x in ("n1", "n2", "n3")]) / total[rows]
            p[rows] = lower
            rows = rows[known[rows]]
            h = _hash([number[context], number[local]])
            frequent = (of["count"] > m.hot) | (m.order == 2)
            shard = _part(_hash([number]), m.shards)[context]
            for name, mine in (("pairs", frequent[context]), ("shard", ~frequent[context])):
                to = _part(h, m.shards) if name == "pairs" else shard
                for some, file, _ in self._by_part(name, to, rows[mine[rows]]):
                    at, found = file.find("2", h[some])
                    some = some[found]
                    p[some] += self._discounted(2, file.column("2.count", at[found])) / total[some]
            often = frequent[context]
        for k in range(3, m.order + 1):
            if k == 3:
                shard = np.where(often, _part(_hash([number[before[1]], number[context]]), m.shards), shard)
            above = _hash([number[x] for x in before[k - 2 :: -1]])
            h = _join(above, number[local])
            seen = np.flatnonzero(np.logical_and.reduce([number[x] != UNKNOWN for x in before[: k - 1]]))
            for rows, file, _ in self._by_part("shard", shard, seen):
                at, found = file.find(f"{k}c", above[rows])
                rows, at = rows[found], at[found]
                total = file.column(f"{k}c.total", at).astype(float)
                q = p[rows] * self._left(k, [file.column(f"{k}c.{x}", at) for x in ("n1", "n2", "n3")]) / total
                at, found = file.find(f"{k}", h[rows])
                q[found] += self._discounted(k, file.column(f"{k}.count", at[found])) / total[found]
                p[rows] = q
        return p, of["count"][local]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, base_score, score, perplexity.

    score: the model's log10 probability of the text's words and its end; perplexity: of its tokens. base_score: that of single
    words with 0.5 added to their counts. n_known: tokens that training has. A null or empty text has its end only; a text of any length
    is read whole, in one task; rows that repeat an id are scored each, and equal texts alike; other columns are not read, whatever their
    names; an empty table gives no rows. A model of no text gives every token probability 1.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, reader = Words(), Reader(model)
        for batch in batches:
            columns = []
            for _, data, offsets in text_slices(batch.column(1), 2 << 20):
                words, doc = _sequences(*scan(data, offsets)[3:1:-1], len(offsets) - 1)
                p, raw = reader.probabilities(words, doc)
                base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
                first = np.searchsorted(doc, np.arange(len(offsets) - 1))
                n = np.diff(first, append=len(words))
                columns.append((n, np.add.reduceat((raw > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)))
            n, known, base, logs = (np.concatenate(c) for c in zip(*columns)) if columns else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, known, base, logs, 10 ** (-logs / np.maximum(n, 1))))], OUT)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


OUT = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
