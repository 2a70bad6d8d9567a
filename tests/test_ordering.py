"""Numbers and batches along an order that is cut into ranges, against one loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import batching, ordering
from docloom.streaming import windows


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_numbers(spark, range_rows):
    rows = [(random.Random(i).randrange(50), i) for i in range(120)] + [(None, 7)]
    table = spark.createDataFrame(rows, "a int, b int")
    found = [(r.a, r.b, r.number) for r in ordering.numbered(table, ["a", "b"], range_rows=range_rows).orderBy("number").collect()]
    assert found == [(*r, i) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))]
    assert ordering.numbered(table.limit(0), ["a"]).collect() == []


def plain_batches(rows, most):
    out, batch, pending, kind = [], -1, 0, None
    for n, k, alone in rows:
        n, alone = max(1, n or 1), bool(alone)
        single = alone or n > most
        if single or not pending or kind != k or pending + n > most:
            batch, pending = batch + 1, 0
        pending, kind = 0 if single else pending + n, k
        out.append(batch)
    return out


@pytest.mark.parametrize("range_rows", [1, 5, 40, 1000])
def test_batches(spark, range_rows):
    for seed, kinds in ((1, "a"), (2, "aab"), (3, "abc"), (4, "aaaaaaaaaab")):
        rng = random.Random(seed)
        kind, rows = "a", []
        for i in range(160):
            kind = rng.choice(kinds) if rng.random() < 0.3 else kind
            rows.append((i, rng.choice([1, 2, 3, 5, 8, 13, 32, 33, 90, None, 0] if seed % 2 else [1, 1, 2]), kind, rng.random() < 0.05 if seed < 4 else None))
        table = spark.createDataFrame(rows, "id int, n int, kind string, alone boolean").repartition(3)
        found = [r.batch for r in batching.pack_batches(table, ["id"], "n", "kind", F.col("alone"), range_rows=range_rows).orderBy("id").collect()]
        assert found == plain_batches([r[1:] for r in rows], 32)


def test_no_rows_to_pack(spark):
    table = spark.createDataFrame([], "id int, n int, kind string")
    assert batching.pack_batches(table, ["id"], "n", "kind", F.lit(False)).collect() == []


def hot_events(n, seed=0):
    """Events of which one key has most; ties in time."""
    rng, now, rows = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([0, 1, 3, 20])
        rows.append((rng.choice(["hot"] * 6 + ["a", "b", None]), i, now, rng.choice([True, True, False, None]), now + rng.randrange(-5, 60) if rng.random() < 0.7 else None))
    return rows


@pytest.mark.parametrize("range_rows", [1, 9, 1000])
def test_hot_keys_in_ranges(spark, range_rows):
    rows = hot_events(150)
    table = spark.createDataFrame(rows, "k string, id int, t long, failed boolean, until long").repartition(3)
    found = {r.id: (r.available, r.active_until, r.failures) for r in windows.provider_windows(table, "k", "t", "id", "failed", "until", 10, range_rows=range_rows).collect()}
    state, want, places, joined, longest = {}, {}, {}, {}, {}
    for k, i, t, failed, until in rows:
        limit, failures = state.get(k, (None, 0))
        if failed:
            limit = max(x for x in (limit, until if until is not None else t + 10) if x is not None)
        failures = failures + 1 if failed else 0
        state[k] = limit, failures
        lasts = limit is not None and limit > t
        want[i] = (not lasts, limit if lasts else None, failures)
        n = places[k] = places.get(k, -1) + 1
        joined[k, n // 4] = joined.get((k, n // 4), "") + f"{i},"
    assert found == want
    pieces = windows.coalesced(table.withColumn("x", F.concat(F.col("id").cast("string"), F.lit(","))), "k", "id", "x", 4, range_rows=range_rows).collect()
    assert {(r.k, r.batch): r.text for r in pieces} == joined
    limits = windows.extended_limits(table.where("until IS NOT NULL"), "k", "id", "until", range_rows=range_rows).collect()
    for k, i, _, _, until in rows:
        if until is not None:
            longest[k] = max(longest.get(k, until), until)
            want[i] = longest[k]
    assert {r.id: r.active_until for r in limits} == {i: want[i] for _, i, _, _, until in rows if until is not None}
