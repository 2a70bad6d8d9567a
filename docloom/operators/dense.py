"""Dense retrieval: exact cosine top-k of a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparse import top_k

#: Bytes of query vectors that are sent to the workers at a time, at most, and of scores that are made at once.
BLOCK_BYTES, SCORE_BYTES = 32 << 20, 32 << 20


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a vector of no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    wide = lambda x: F.transform(x, lambda y: y.cast("double"))
    a, b = wide(a), wide(b)
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, total(F.zip_with(a, b, lambda x, y: x * y)) / norm)


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query by descending score, then key; sorted by query."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], key[kept], score[kept]


def _scope(lists: pa.Array, names: np.ndarray) -> np.ndarray:
    """[query, row]: whether the row's list has the query's name. names are sorted."""
    lengths = np.array(lists.value_lengths().fill_null(0), np.int64)
    values, row = np.array(lists.flatten(), np.int64), np.repeat(np.arange(len(lists)), lengths)
    at = np.searchsorted(names, values)
    known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == values)
    out = np.zeros((len(names), len(lists)), bool)
    out[at[known], row[known]] = True
    return out


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", keep_self: bool = True, digits: int = 6, inside: str | None = None) -> DataFrame:
    """(query, key, score, rank): the k nearest rows of vectors for each row of queries, by cosine rounded to `digits`, then key.

    Each task keeps its own k best per query, so only those are shuffled. Queries are dealt by hash to blocks of some BLOCK_BYTES, of which one at a time is
    with the driver; each scans vectors once. Null vectors and vectors of another length than the queries' are no neighbours.
    inside: a column of vectors, the array of the queries' keys in whose scope a row lies; other queries don't see it.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(embedding).isNotNull()).select(key, embedding, *([F.col(inside).cast("array<long>")] if inside else []))
    asked = queries.where(F.col(embedding).isNotNull()).select(key, embedding)
    count, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(embedding)), F.lit(0))).first()
    blocks, found = max(1, -(-count * width * 8 // BLOCK_BYTES)), None
    for block in range(blocks):
        data = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).orderBy(key).toArrow()
        names = np.array(data.column(0), np.int64)
        matrix = np.array(data.column(1).combine_chunks().flatten(), np.float64).reshape(len(names), -1) if len(names) else np.zeros((0, 1))
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            at_once = max(1, SCORE_BYTES // (8 * max(1, len(names))))
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            # Of a query with k entries, the score that a row has to reach.
            floor = np.full(len(names), -np.inf)
            for batch in batches:
                lists = batch.column(1)
                fits = np.array(lists.value_lengths()) == matrix.shape[1] if len(names) else np.zeros(len(lists), bool)
                x = np.array(lists.filter(pa.array(fits)).flatten(), np.float64).reshape(-1, matrix.shape[1])
                ids = np.array(batch.column(0), np.int64)[fits]
                seen = _scope(batch.column(2).filter(pa.array(fits)), names) if inside else None
                for at in range(0, len(x), at_once):
                    some, own = x[at : at + at_once], ids[at : at + at_once]
                    s = np.round(matrix @ (some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300)).T, digits) + 0.0
                    if seen is not None:
                        s[~seen[:, at : at + at_once]] = -np.inf
                    if not keep_self:
                        s[names[:, None] == own[None, :]] = -np.inf
                    if len(own) > k:
                        floor = np.maximum(floor, np.partition(s, len(own) - k, axis=1)[:, len(own) - k])
                    q, c = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
                    best = _best(*(np.concatenate(pair) for pair in zip(best, (q, own[c], s[q, c]))), k)
                    last = np.flatnonzero(np.bincount(best[0], minlength=len(names)) == k)
                    floor[last] = np.maximum(floor[last], best[2][np.searchsorted(best[0], last, "right") - 1])
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", key, "score"])

        part = rows.mapInArrow(search, f"query long, {key} long, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, "query", key, k)
