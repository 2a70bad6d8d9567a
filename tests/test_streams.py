"""Stateful streams: state that ends, late events, restarts from the checkpoint."""

import datetime

from docloom.streaming import jobs, windows


class Stream:
    """A stream over files of a folder; each feed adds one and is read as one batch."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.source, self.target, self.checkpoint, self.schema, self.job = spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", schema, job

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        out = self.job(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.source))
        query = out.writeStream.format("parquet").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start(self.target)
        query.awaitTermination(300)
        assert query.exception() is None
        return [x for p in query.recentProgress for x in p.stateOperators]

    def rows(self):
        return self.spark.read.parquet(self.target).collect()


def at(seconds):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def test_limits_end_with_their_windows(spark, tmp_path):
    s = Stream(spark, tmp_path, "key long, id long, ts timestamp, delivered boolean", lambda df: jobs.limit_per_key(df, late="1 minute", seconds=3600))
    # Each feed is a query of its own that goes on from the checkpoint.
    s.feed([(1, i, at(t), None) for i, t in enumerate((0, 10, 20, 30))] + [(2, 9, at(5), False), (2, 10, at(6), True), (2, 11, at(7), True), (2, 12, at(8), True), (2, 13, at(9), True)])
    s.feed([(1, 20, at(40), True)])
    assert {(r.key, r.id): r.accepted for r in s.rows()} == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (1, 20): False, (2, 9): True, (2, 10): True, (2, 11): True, (2, 12): True, (2, 13): False}
    s.feed([(3, 30, at(20_000), True)])
    kept = s.feed([(1, 40, at(20_010), True), (1, 41, at(100), True)])
    found = {(r.key, r.id): r.accepted for r in s.rows()}
    # A new window; what is later than the watermark is in none.
    assert found[1, 40] and (1, 41) not in found
    # The passed windows of 1 and 2 went; those of 3 and, anew, 1 are left.
    assert kept[-1].numRowsTotal <= 2 * 3


def test_limits_are_those_of_one_pass(spark, tmp_path):
    import random

    rng, now, batches, seen = random.Random(3), 0, [], []
    for _ in range(4):
        batch = []
        for _ in range(40):
            now += rng.choice([1, 5, 60, 900])
            batch.append((rng.randrange(3), len(seen) + len(batch), at(now), rng.random() < 0.8))
        batches.append(batch)
        seen += batch
    s = Stream(spark, tmp_path, "key long, id long, ts timestamp, delivered boolean", lambda df: jobs.limit_per_key(df, late="0 seconds", seconds=1800))
    for batch in batches:
        s.feed(batch)
    want, state = {}, {}
    for key, i, t, delivered in seen:
        want[key, i] = state.setdefault(key, windows.FixedWindow(3, 1800)).accept((t - at(0)).total_seconds(), delivered)
    assert {(r.key, r.id): r.accepted for r in s.rows()} == want


def test_sessions_are_forgotten(spark, tmp_path):
    s = Stream(spark, tmp_path, "session long, turn long, role string, text string, complete boolean, ts timestamp", lambda df: jobs.remember_exchanges(df, late="1 minute", idle_seconds=600))
    s.feed([(1, 0, "user", "q1", True, at(0)), (1, 1, "assistant", "a1", True, at(1)), (1, 2, "user", "q2", True, at(2)), (1, 3, "assistant", "cut", False, at(3)), (2, 0, "assistant", "x", True, at(4)), (4, 0, "user", "open", True, at(5))])
    s.feed([(1, 4, "assistant", "a2", True, at(100)), (3, 0, "user", "other", True, at(5000))])
    s.feed([(1, 5, "user", "q3", True, at(5001)), (1, 6, "assistant", "a3", True, at(5002)), (4, 1, "assistant", "too late", True, at(5003))])
    assert sorted(tuple(r) for r in s.rows()) == [(1, 1, "q1", "a1"), (1, 1, "q3", "a3"), (1, 2, "q2", "a2")]
