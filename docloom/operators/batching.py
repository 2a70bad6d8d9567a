"""Batches of an ordered stream: rows are packed as they come, up to a number of chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import RANGE, RANGE_ROWS, fold_ranges, ranges

MOST_CHUNKS = 32


def _steps(chunks: list, kinds: list, alone: list, pending: int, most: int) -> Iterator[tuple[bool, int]]:
    """For each row whether it begins a batch, and the chunks of the batch that is then open, when `pending` are open at the beginning (0: none)."""
    last = kinds[0]
    for n, kind, single in zip(chunks, kinds, alone):
        fits = not single and 0 < pending and kind == last and pending + n <= most
        pending, last = 0 if single else pending + n if fits else n, kind
        yield not fits, pending


def pack_batches(rows: DataFrame, order: Sequence[str | Column], chunks: str, kind: str, alone: Column, most: int = MOST_CHUNKS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with batch (0, 1, ... along the order): each row joins the open batch if it is of the batch's kind and its chunks fit, else it begins one.

    alone: rows that are a batch by themselves, and close the one before: replacements, deferred and settled rows; rows of more than `most` chunks are, too. A row has
    one chunk at least. All rows are one stream; it is cut into ranges, for each of which it is worked out how it ends whatever number of chunks
    is open at its beginning. Those ends soon agree, so this is about one pass; ranges are then put in a row.
    """
    single = (F.coalesce(alone, F.lit(False)) | (F.coalesce(F.col(chunks), F.lit(1)) > most)).alias("__alone")
    dealt = ranges(rows.select(*rows.columns, single, F.greatest(F.lit(1), F.coalesce(F.col(chunks), F.lit(1))).cast("long").alias("__chunks"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("__kind")), order, range_rows)

    def lists(group: pa.Table) -> tuple[list, list, list]:
        return group.column("__chunks").to_pylist(), group.column("__kind").to_pylist(), group.column("__alone").to_pylist()

    def tables(group: pa.Table) -> dict:
        rows = lists(group)
        base = list(_steps(*rows, 0, most))
        ends, begun = [base[-1][1]], [sum(b for b, _ in base)]
        for pending in range(1, most + 1):
            end, more = pending, 0
            for (begins, end), (base_begins, _) in zip(_steps(*rows, pending, most), base):
                more += begins - base_begins
                if begins and base_begins:
                    end = ends[0]  # from here on both are the same
                    break
            ends.append(end)
            begun.append(begun[0] + more)
        return {"first": rows[1][0], "last": rows[1][-1], "ends": ends, "begun": begun}

    def entries(found: list) -> dict[int, tuple]:
        out, pending, batches, last = {}, 0, 0, None
        for r in found:
            pending = pending if r["first"] == last else 0
            out[r[RANGE]] = (pending, batches)
            batches, pending, last = batches + r["begun"][pending], r["ends"][pending], r["last"]
        return out

    def number(group: pa.Table, state: tuple) -> pa.Array:
        begins = [b for b, _ in _steps(*lists(group), state[0], most)]
        return pa.array(np.cumsum(begins) + state[1] - 1, pa.int64())

    packed = fold_ranges(dealt, ["__chunks", "__kind", "__alone"], tables, "first string, last string, ends array<int>, begun array<long>", entries, number, "batch", "long")
    return packed.select(*rows.columns, "batch")
