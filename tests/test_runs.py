"""Runs that are live, dead, resumed or refused, and outcomes up to the first failure."""

from pyspark.sql import functions as F

from docloom.operators import runs
from docloom.sources import files

SCHEMA = "directory string, fingerprint string, lifecycle string, eligible long, processed long, skipped long, failed long, in_progress long, owner string, seen long"
OLD = [
    ("live", "f", "RUNNING", 10, 3, 1, 1, 2, "a", 95), ("dead", "f", "RUNNING", 10, 3, 1, 1, 2, "a", 5), ("partial", "f", "PARTIAL", 10, 3, 1, 6, 0, "a", 5), ("complete", "f", "COMPLETE", 10, 9, 1, 0, 0, "a", 5), ("changed", "old", "PARTIAL", 10, 3, 1, 1, 0, "a", 5), ("grown", "f", "PARTIAL", 9, 3, 1, 1, 0, "a", 5), ("own", "f", "RUNNING", 10, 3, 0, 0, 1, "b", 99),
]


def test_dead_runs_are_partial(spark):
    found = {r.directory: (r.lifecycle, r.inspected, r.failed, r.in_progress, r.pending) for r in runs.reconciled(spark.createDataFrame(OLD, SCHEMA), F.lit(100), 50).collect()}
    assert found["live"] == ("RUNNING", 5, 1, 2, 3) and found["dead"] == ("PARTIAL", 4, 0, 0, 6) and found["partial"] == ("PARTIAL", 10, 6, 0, 0) and found["complete"] == ("COMPLETE", 10, 0, 0, 0)


def test_claims(spark):
    wanted = spark.createDataFrame([(d, "f", 10, "b") for d in [*(r[0] for r in OLD), "new"]], "directory string, fingerprint string, eligible long, owner string")
    found = {r.directory: (r.claim, r.processed, r.failed, r.owner, r.seen) for r in runs.claimed(spark.createDataFrame(OLD, SCHEMA), wanted, F.lit(100), 50).collect()}
    assert found == {
        "live": ("refused", 3, 1, "a", 95), "dead": ("resumed", 3, 0, "b", 100), "partial": ("resumed", 3, 0, "b", 100), "complete": ("fresh", 0, 0, "b", 100), "changed": ("fresh", 0, 0, "b", 100), "grown": ("fresh", 0, 0, "b", 100), "own": ("resumed", 3, 0, "b", 100), "new": ("fresh", 0, 0, "b", 100),
    }
    assert runs.claimed(spark.createDataFrame([], SCHEMA), wanted, F.lit(100), 50).where("claim = 'fresh'").count() == 8


def test_outcomes_stop_at_the_first_failure(spark):
    table = spark.createDataFrame([("a", i, i in (3, 5)) for i in range(8)] + [(None, 0, False), (None, 1, True), (None, 2, None), ("b", 0, None)], "run string, at int, failed boolean")
    assert sorted((str(r.run), r["at"]) for r in runs.until_first_failure(table, "run", "at", "failed").collect()) == [("None", 0), ("None", 1), ("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]


def test_types_of_no_module_are_counted(spark):
    types = spark.createDataFrame([("p", "A"), ("q", "B"), ("q", "C")], "package string, type string")
    assert [tuple(r) for r in files.unmatched_types(types, spark.createDataFrame([("p", "m"), ("p", "n")], "package string, module string")).collect()] == [("q", 2)]
