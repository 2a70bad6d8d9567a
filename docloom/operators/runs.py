"""Runs of ingestion over directories: which is live, which may be resumed and from where, and outcomes up to the first failure.

A run is a row (directory, fingerprint, lifecycle, eligible, processed, skipped, failed, in_progress, owner, seen): fingerprint is that of the inventory of its
files, seen the last time that its owner wrote it. What is not seen for `lease` seconds is dead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lifecycles of a run.
NOT_STARTED, RUNNING, PARTIAL, COMPLETE = "NOT_STARTED", "RUNNING", "PARTIAL", "COMPLETE"


def is_live(now: Column, lease: int) -> Column:
    return F.coalesce((F.col("lifecycle") == RUNNING) & (F.col("seen") > now - lease), F.lit(False))


def reconciled(runs: DataFrame, now: Column, lease: int) -> DataFrame:
    """runs with inspected and pending; those that are RUNNING but dead are PARTIAL: what succeeded stays, failed and interrupted files are pending again."""
    dead = (F.col("lifecycle") == RUNNING) & ~is_live(now, lease)
    done = F.col("processed") + F.col("skipped")
    out = runs.withColumns({"__dead": dead, "inspected": F.when(dead, done).otherwise(done + F.col("failed"))})
    out = out.withColumns({"failed": F.when(F.col("__dead"), 0).otherwise(F.col("failed")).cast("long"), "in_progress": F.when(F.col("__dead"), 0).otherwise(F.col("in_progress")).cast("long"), "lifecycle": F.when(F.col("__dead"), PARTIAL).otherwise(F.col("lifecycle"))})
    return out.withColumn("pending", F.col("eligible") - F.col("inspected") - F.col("in_progress")).drop("__dead")


def claimed(runs: DataFrame, wanted: DataFrame, now: Column, lease: int) -> DataFrame:
    """wanted (directory, fingerprint, eligible, owner) as runs that begin now, with claim: `refused` (another owner's run of the directory is live; its row is as it was), `resumed` or `fresh`.

    A run that ended before all was done is resumed after what succeeded, if neither the inventory nor its number of files has changed. Completed runs, and those of another inventory, begin
    anew. A directory has one run.
    """
    old = runs.select(*(F.col(c).alias(f"__{c}") for c in runs.columns), is_live(now, lease).alias("__live"))
    met = wanted.join(old, wanted["directory"] == old["__directory"], "left")
    refused = F.coalesce(F.col("__live") & ~F.col("__owner").eqNullSafe(F.col("owner")), F.lit(False))
    same = (F.col("__fingerprint") == F.col("fingerprint")) & (F.col("__eligible") == F.col("eligible")) & F.col("__lifecycle").isin(RUNNING, PARTIAL)
    claim = F.when(refused, "refused").when(F.coalesce(same, F.lit(False)), "resumed").otherwise("fresh")
    met = met.withColumn("claim", claim)
    kept = lambda c: F.when(F.col("claim") == "fresh", 0).otherwise(F.col(f"__{c}")).cast("long").alias(c)
    own = lambda c, new: F.when(F.col("claim") == "refused", F.col(f"__{c}")).otherwise(new).alias(c)
    zero = F.lit(0).cast("long")
    return met.select(
        "directory", own("fingerprint", F.col("fingerprint")), F.lit(RUNNING).alias("lifecycle"), own("eligible", F.col("eligible")), kept("processed"), kept("skipped"), own("failed", zero), own("in_progress", zero), own("owner", F.col("owner")), own("seen", now), "claim"
    )


def until_first_failure(outcomes: DataFrame, by: str, order: str, failed: str) -> DataFrame:
    """outcomes of each run up to its first failure, which is in; what comes after was not attempted. By the place of the first failure alone, so a run of any number of files is no hot key."""
    first = outcomes.where(F.col(failed)).groupBy(F.col(by).alias("__by")).agg(F.min(order).alias("__first"))
    met = outcomes.join(first, outcomes[by].eqNullSafe(first["__by"]), "left")
    return met.where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).select(*outcomes.columns)
