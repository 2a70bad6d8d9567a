"""Benchmark decontamination: a broadcast hash set of the test items' windows, scanned against every window of the documents.

Hash hits are verified word by word. The set is sorted arrays, broadcast up to a number of bytes (and of windows); a larger one is dealt into
slices by hash, the documents are scanned once for each slice, and the hits of a document are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .words import ALPHANUMERIC, Words, grams, text_slices

WINDOW = 10
MOST_WINDOWS, MOST_BYTES = 1_000_000, 64 << 20


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, words, h, gram) of each window: the number of words, their hash, the words joined by spaces."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words(ALPHANUMERIC)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                starts, ends, doc, h = scan(data, offsets)
                raw, out = data.tobytes(), []
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    if b > a:
                        k = min(window, b - a)
                        words = [raw[s:e] for s, e in zip(starts[a:b], ends[a:b])]
                        item = batch.column(0)[first + i].as_py() or ""
                        out += [(item, k, int(x), b" ".join(words[j : j + k])) for j, x in enumerate(grams(h[a:b], k).view(np.int64))]
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["item", "words", "h", "gram"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(find, "item string, words int, h long, gram binary").distinct()


def _slices(windows: DataFrame, most_windows: int) -> int:
    """Into how many parts windows are dealt, so that none has more windows or bytes than it may."""
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + F.octet_length("item") + 32).alias("bytes")).first()
    return max(1, -(-size["n"] // most_windows), -(-(size["bytes"] or 0) // MOST_BYTES))


def _scanner(windows: DataFrame, whole: bool):
    """windows: a part of them, which the driver gathers as arrays and workers get."""
    table = windows.select("words", "h", "gram", "item").toArrow()
    keys = table.column("h").to_numpy().view(np.uint64)
    order = np.lexsort((keys, table.column("words").to_numpy()))
    table, keys = table.take(order), keys[order]
    sizes, first = np.unique(table.column("words").to_numpy(), return_index=True)
    sets = {int(k): slice(int(i), int(j)) for k, i, j in zip(sizes, first, [*first[1:], len(keys)])}
    grams_ = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("gram").chunks] or [pa.array([], pa.large_binary())])
    ends = np.cumsum(pc.binary_length(grams_).to_numpy(zero_copy_only=False), dtype=np.int64)
    names, item = np.unique(np.array(table.column("item").to_pylist(), object).astype(str), return_inverse=True)
    shared = windows.sparkSession.sparkContext.broadcast((sets, keys, np.concatenate([[0], ends]).astype(np.int64), b"".join(grams_.to_pylist()), names.tolist(), item.astype(np.int32)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (sets, every, at, text, names, item) = Words(ALPHANUMERIC), shared.value
        for batch in batches:
            n_words, places, items = [], [], []
            for _, data, offsets in text_slices(batch.column(1)):
                starts, ends, doc, h = words(data, offsets)
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                hit, found_items = np.zeros(len(starts), bool), {}
                for k, of in sets.items():
                    if len(h) < k:
                        continue
                    g, keys = grams(h, k), every[of]
                    place = np.searchsorted(keys, g)
                    near = keys[np.minimum(place, len(keys) - 1)] == g
                    for i in np.flatnonzero(near & (doc[: len(g)] == doc[k - 1 :])):
                        said = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + k], ends[i : i + k]))
                        j = of.start + int(place[i])
                        while j < of.stop and every[j] == g[i]:
                            if text[at[j] : at[j + 1]] == said:
                                hit[i : i + k] = True
                                found_items.setdefault(int(doc[i]), set()).add(names[item[j]])
                            j += 1
                n_words += np.diff(bounds).tolist()
                for i in range(len(offsets) - 1):
                    some = i in found_items
                    places.append(np.flatnonzero(hit[bounds[i] : bounds[i + 1]]).tolist() if some else [])
                    items.append(sorted(found_items[i]) if some else [])
            if whole:
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_words, pa.int64()), pa.array(map(len, places), pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digests, pa.string())], OUT
                )
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "t", "n_words", "places", "items"])

    return scan


OUT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. A window is `window` consecutive words of an
    item, or a shorter item's all words. A document's word inside any occurrence of a window is hit. Null and empty texts have
    no words; an item without an id has the empty id; an empty benchmark hits nothing. Texts of any length are scanned whole, in their task. Rows that
    repeat an id are judged each; other columns are not read, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    windows = settle(item_windows(items, item_id, item_text, window), "windows")
    slices = _slices(windows, most_windows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if slices == 1:
        out = rows.mapInArrow(_scanner(windows, True), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    else:
        # Rows of one id and text have the same hits.
        rows = rows.withColumn("t", F.sha2(F.coalesce("text", F.lit("")), 256))
        scans = []
        for i in range(slices):
            part = windows.where(F.pmod("h", F.lit(slices)) == i)
            found = rows.mapInArrow(_scanner(part, False), f"doc_id {kind}, t string, n_words long, places array<int>, items array<string>")
            scans.append(settle(found if i == 0 else found.where("size(items) > 0"), f"hits-{i}"))
        base = scans[0].select("doc_id", "t", "n_words")
        every = scans[0].where("size(items) > 0")
        for x in scans[1:]:
            every = every.unionByName(x)
        hits = every.groupBy("doc_id", "t").agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
        )
        hits = hits.withColumnsRenamed({"doc_id": "hit_id", "t": "hit_t"})
        joined = base.join(hits, base["doc_id"].eqNullSafe(hits["hit_id"]) & (base["t"] == hits["hit_t"]), "left")
        names = F.coalesce("items", F.array().cast("array<string>"))
        out = joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs without any hit, with all their columns. Each row is judged on its own, in one pass over the texts for each slice of windows; a pass leaves the next one only the rows that it did not hit."""
    windows = settle(item_windows(items, "item_id", "text", WINDOW), "windows")
    slices = _slices(windows, most_windows)
    for i in range(slices):
        if i:
            docs = settle(docs, f"clean-{i}")
        part = windows.where(F.pmod("h", F.lit(slices)) == i)
        docs = docs.mapInArrow(_cleaner(_scanner(part, True)), docs.schema)
    return docs


def _cleaner(scan):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            n = pa.array(range(len(text)), pa.int64())
            hits = pa.concat_arrays([x.column(2) for x in scan(iter([pa.RecordBatch.from_arrays([n, text], ["n", "text"])]))])
            yield batch.filter(pc.equal(hits, 0))

    return clean
