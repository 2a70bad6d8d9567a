"""Per-key folds over time, for batches; the streaming jobs use the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import ordering


class FixedWindow:
    """At most `most` acceptances within `seconds` of the window's first; the next one after that starts a new window. What is not delivered gives its place back."""

    def __init__(self, most: int = 3, seconds: int = 3600):
        self.most, self.seconds, self.began, self.used = most, seconds, None, 0

    def accept(self, at: float, delivered: bool = True) -> bool:
        if self.began is None or at >= self.began + self.seconds:
            self.began, self.used = at, 0
        if self.used >= self.most:
            return False
        self.used += delivered
        return True


def fixed_window_limit(events: DataFrame, key: str, ts: str, order: str, most: int = 3, seconds: int = 3600, delivered: str | None = None) -> DataFrame:
    """events (key and order are integers) with accepted; delivered: a boolean column, null counts as true. Each task reads its keys' events in order and holds one window at a time, however many a key has."""
    rows = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), F.coalesce(delivered, F.lit(True)).alias("__delivered") if delivered else F.lit(True).alias("__delivered")).repartition(key).sortWithinPartitions(key, "__at", order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = object(), None
        for batch in batches:
            said = []
            for k, at, sent in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if k != last:
                    last, window = k, FixedWindow(most, seconds * 1_000_000)
                said.append(window.accept(at, sent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.bool_())], [key, order, "accepted"])

    return rows.mapInArrow(judge, f"{key} long, {order} long, accepted boolean")


def coalesced(rows: DataFrame, by: str, order: str, text: str, size: int = 24, range_rows: int = ordering.RANGE_ROWS) -> DataFrame:
    """(by, batch, text): runs of `size` pieces joined in order. A stream of very many pieces is numbered in ranges."""
    numbered = ordering.numbered_within(rows.select(by, order, text), by, [order], "__number", range_rows).withColumn("batch", F.floor(F.col("__number") / size))
    pieces = F.array_sort(F.collect_list(F.struct("__number", text)))
    return numbered.groupBy(by, "batch").agg(F.array_join(F.transform(pieces, lambda x: x[text]), "").alias("text"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, began, ended, events): runs of events less than the gap apart; ended is the last event's time."""
    window = F.session_window(F.col(ts), f"{gap_seconds} seconds")
    return events.groupBy(key, window).agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events")).drop("session_window")


def extended_limits(limits: DataFrame, key: str, at: str, until: str, range_rows: int = ordering.RANGE_ROWS) -> DataFrame:
    """limits (key, at, until) with active_until after each: a window is only ever extended, or replaced when it has passed. A key of very many rows is cut into ranges."""
    dealt = ordering.key_ranges(limits, key, [at, until], {"__max": F.max(until)}, {"__before": F.max("__max").over(ordering.before())}, range_rows=range_rows)
    so_far = ordering.within(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return dealt.select(*limits.columns, F.greatest("__before", F.max(until).over(so_far)).alias("active_until"))


def provider_windows(events: DataFrame, key: str, at: str, order: str, failed: str, until: str, window: int, range_rows: int = ordering.RANGE_ROWS) -> DataFrame:
    """events with available, active_until and failures, as they are after each in the order of (at, order); at and until are integers of one unit.

    A failed event is a rate limit until `until`, or without one for `window` from at. While a limit lasts it is only ever extended; one that has
    passed is replaced. So the limit that lasts is the largest so far. failures: since the last event that did not fail. A key of very many events is cut
    into ranges, of which the largest limit, the failures at the end and whether any event did not fail are handed on.
    """
    marked = events.withColumns({"__limit": F.when(F.col(failed), F.coalesce(until, F.col(at) + window)), "__bad": F.coalesce(failed, F.lit(False))})
    so_far, good = ordering.within(key).rowsBetween(W.unboundedPreceding, W.currentRow), ~F.col("__bad")
    # The number of failures so far never falls, so at the last event that did not fail it is the largest of such events.
    dealt = ordering.key_ranges(
        marked,
        key,
        [at, order],
        {"__max": F.max("__limit"), "__bads": F.count_if("__bad"), "__calm": F.max(F.when(good, F.col("__n")))},
        {"__limit_before": F.max("__max").over(ordering.before()), "__n_before": F.coalesce(F.sum("__bads").over(ordering.before()), F.lit(0))},
        {"__calm_before": F.max(F.col("__n_before") + F.col("__calm")).over(ordering.before())},
        local={"__n": F.count_if("__bad").over(so_far)},
        range_rows=range_rows,
    )
    largest = F.greatest("__limit_before", F.max("__limit").over(so_far))
    lasting = F.when(largest > F.col(at), largest)
    calm = F.coalesce(F.greatest("__calm_before", F.col("__n_before") + F.max(F.when(good, F.col("__n"))).over(so_far)), F.lit(0))
    return dealt.select(*events.columns, lasting.isNull().alias("available"), lasting.alias("active_until"), (F.col("__n_before") + F.col("__n") - calm).alias("failures"))
