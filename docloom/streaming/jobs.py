"""Streaming jobs: incremental ingestion with a checkpoint, conversation state, and rate limits per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .windows import FixedWindow


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 32) -> StreamingQuery:
    """Reads new Parquet files of source in batches and appends what `prepare` makes of them to target, each batch once.

    A batch is written to a folder of its own number, so one that is repeated after a failure overwrites itself. The checkpoint resumes the backlog.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Stateful processors keep their state in RocksDB, on disk beside the executor and in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ending(StatefulProcessor):
    """A processor with one value of state per key and one timer, at which the state goes."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def keep(self, value: tuple, until: float) -> None:
        """value as the state, up to `until` (epoch seconds)."""
        self.state.update(value)
        wanted = int(until * 1000)
        for timer in list(self.handle.listTimers()):
            if timer != wanted:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, ts: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def _seconds(frames: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    return rows.assign(__at=(rows[ts] - pd.Timestamp(0)) / pd.Timedelta(seconds=1))


class _Exchanges(_Ending):
    schema = "question string, n long"

    def __init__(self, ts: str, idle: float):
        self.ts, self.idle = ts, idle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        question, n = self.state.get() if self.state.exists() else (None, 0)
        turns, out = _seconds(rows, self.ts).sort_values("turn"), []
        for r in turns.itertuples():
            if r.role == "user":
                question = r.text
            elif r.role == "assistant" and r.complete and question is not None:
                n += 1
                out.append((key[0], n, question, r.text))
                question = None
        self.keep((question, n), turns[turns.columns[-1]].max() + self.idle)
        yield pd.DataFrame(out, columns=["session", "exchange", "user_text", "assistant_text"])


def remember_exchanges(turns: DataFrame, ts: str = "ts", late: str = "10 minutes", idle_seconds: float = 86400) -> DataFrame:
    """From turns (session, turn, role, text, complete, ts): (session, exchange, user_text, assistant_text) whenever a reply is complete.

    A session's state is its open question and the number of exchanges; a reply that is not complete, or without a question, adds nothing. A session that
    says nothing for idle_seconds of event time is forgotten; what comes after that is a new one. Turns later than the watermark are left out.
    """
    return _stateful(turns, "session", ts, late, _Exchanges(ts, idle_seconds), "session long, exchange long, user_text string, assistant_text string")


class _Limits(_Ending):
    schema = "began double, used int"

    def __init__(self, ts: str, most: int, seconds: int):
        self.ts, self.most, self.seconds = ts, most, seconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = FixedWindow(self.most, self.seconds)
        if self.state.exists():
            window.began, window.used = self.state.get()
        events = _seconds(rows, self.ts)
        at = events.columns[-1]
        events = events.sort_values([at, "id"])
        out = [(key[0], i, window.accept(t, d is None or bool(d))) for i, t, d in zip(events["id"], events[at], events["delivered"])]
        self.keep((float(window.began), int(window.used)), window.began + self.seconds)
        yield pd.DataFrame(out, columns=["key", "id", "accepted"])


def limit_per_key(events: DataFrame, ts: str = "ts", late: str = "10 minutes", most: int = 3, seconds: int = 3600) -> DataFrame:
    """From events (key, id, ts, delivered): (key, id, accepted) by the fixed window of the key, which is its state, and goes when the window has passed.

    What is not delivered gives its place back. Events later than the watermark are left out; no other one can meet a window that has gone, so the
    results are those of a state that is never dropped.
    """
    return _stateful(events, "key", ts, late, _Limits(ts, most, seconds), "key long, id long, accepted boolean")


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(began, key, n) per window; events later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("began"), key, "n")
