"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. Where a source's budget runs out within a bucket, only that bucket is cut into
finer ones, and so on until the boundary holds one hash. Documents are then taken by comparing their hash with their
source's threshold: nothing is sorted, a larger budget takes a superset, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle, unused, word_count

WEIGHTS = (5, 2, 1)
#: A source's words are taken at most so often.
MOST = 3
BUCKET_BITS = 12
LEVELS = 5
HASH_BITS = BUCKET_BITS * LEVELS


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits; rows without an id are told apart by their text."""
    key = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Sources by code point, null last, weigh as weights repeat; together they get all words. A target stops at most times its
    source's size and the excess goes to the others by weight: with sources by rising cap over weight, the first whose share
    of what is left stays within its cap fixes the share per weight for itself and all after it.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    named = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    by_cap = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = named.select(
        "*",
        (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).alias("words_left"),
        (F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    fits = F.col("words_left").cast("double") * F.col("w") <= most * F.col("source_size").cast("double") * F.col("w_left")
    share = F.first(F.when(fits, F.struct("words_left", "w_left")), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = left.withColumn("share", share)
    target = F.when(F.col("share").isNull(), (most * F.col("source_size")).cast("double")).otherwise(
        F.col("share.words_left").cast("double") * F.col("w").cast("double") / F.col("share.w_left").cast("double")
    )
    return found.select("source", "source_size", target.alias("target"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(of, source_size, target, full, low) by source for settled (source, size, h): every document is taken `full` times, those with h < low once more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = source_targets(sizes, weights, most).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    # low: hashes below are taken; rest: words still to take from the range of 2**bits hashes at low, 0 when done.
    plan = settle(plan.withColumn("low", F.lit(0).cast("long")), "plan-0")
    for level in range(1, LEVELS + 1):
        bits = HASH_BITS - BUCKET_BITS * level
        near = plan.select(F.col("source").alias("of"), "low", "rest").where("rest > 0")
        inside = rows.join(near, rows["source"].eqNullSafe(near["of"]) & (F.shiftright("h", bits + BUCKET_BITS) == F.shiftright("low", bits + BUCKET_BITS)))
        histogram = inside.groupBy("of", F.shiftright("h", bits).alias("bucket"), "rest").agg(F.sum("size").alias("words"), F.min("h").alias("first_h"), F.max("h").alias("last_h"))
        upto = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        edge = histogram.withColumn("upto", F.sum("words").over(upto)).where("upto > rest AND upto - words <= rest")
        edge = edge.select(
            "of",
            F.struct(
                F.shiftleft("bucket", bits).alias("low"),
                (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"),
                "words",
                (F.col("first_h") == F.col("last_h")).alias("one"),
                "last_h",
            ).alias("e"),
        )
        ends, nearer = F.col("e.one") | F.lit(level == LEVELS), F.col("e.words") < 2 * F.col("e.rest")
        low = F.when(F.col("e").isNull(), F.col("low")).when(ends & nearer, F.col("e.last_h") + 1).otherwise(F.col("e.low"))
        rest = F.when(F.col("e").isNull() | ends, F.lit(0.0)).otherwise(F.col("e.rest"))
        moved = plan.join(edge, plan["source"].eqNullSafe(edge["of"]), "left")
        plan = settle(moved.select("source", "source_size", "target", "full", rest.alias("rest"), low.alias("low")), f"plan-{level}")
        if plan.where("rest > 0").isEmpty():
            break
    return plan.select(F.col("source").alias("of"), "source_size", "target", "full", "low")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each row: doc_id, size, source, source_size, target, copies, taken (copies times size).

    Every document of a source is taken as often as the target holds the whole source, and those below the source's
    threshold once more; the document at the boundary is taken if that comes nearer to the target. Rows of one hash
    (repeated ids) go together, and ties have one order. Null texts have size 0, texts of any length are counted whole, a null source is a
    source of its own, an empty table gives no rows. The plan has a row a source, and sources are numbered in one task: they must be few enough for that.
    """
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), doc_hash(F.col(doc_id), F.col(text)).alias("h")), "sizes")
    plan = mix_plan(rows, weights, most)
    copies = F.col("full") + F.when((F.col("full") < most) & (F.col("h") < F.col("low")), 1).otherwise(0)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["of"]))
    return joined.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def draw_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others) that the mix takes, with copies (how often) and taken (words).

    Columns of docs that are named copies or taken are replaced.
    """
    size, h = word_count(F.col("text")), doc_hash(F.col("doc_id"), F.col("text"))
    plan = mix_plan(settle(docs.select("source", size.alias("size"), h.alias("h")), "sizes"), weights, most)
    names = {c: unused(docs, f"mix_{c}") for c in ("of", "full", "low")}
    plan = plan.select(*(F.col(c).alias(n) for c, n in names.items()))
    again = (F.col(names["full"]) < most) & (h < F.col(names["low"]))
    copies = F.col(names["full"]) + F.when(again, 1).otherwise(0)
    joined = docs.join(plan, docs["source"].eqNullSafe(plan[names["of"]])).withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("taken", F.col("copies") * size).select(*(c for c in docs.columns if c not in ("copies", "taken")), "copies", "taken")
