"""Fusion of rankings, merging over collections, deduplication and coverage of releases."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank_fusion(rankings: Iterable[DataFrame], by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """(by, key, score): the sum over rankings of 1 / (k + rank), ranks from 1."""
    parts = [r.select(*by, key, (1 / (F.lit(k) + F.col("rank"))).alias("part")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*by, key).agg(F.sum("part").alias("score"))


def best_by_point(points: DataFrame, by: list[str], key: str, collection: Column) -> DataFrame:
    """One row per point: the strictly highest score, ties to the first collection. Map-side aggregation, so a point of many collections is no hot key."""
    best = F.min_by(F.struct(*points.columns), F.struct((-F.col("score")).alias("down"), collection.alias("collection")))
    return points.groupBy(*by, key).agg(best.alias("__best")).select("__best.*")


def first_seen(rows: DataFrame, version: str, content_hash: str, url: Column, *order: str) -> DataFrame:
    """The first row of each (version, hash); without a hash, of each URL; rows with neither are all kept. Map-side aggregation, so a frequent text is no hot key."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    key = F.when(~blank(F.col(content_hash)), F.concat_ws("\0", F.lit("h"), F.coalesce(version, F.lit("")), content_hash)).when(~blank(url), F.concat_ws("\0", F.lit("u"), url))
    keyed = rows.withColumn("__key", key)
    first = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")
    return first.unionByName(keyed.where("__key IS NULL").drop("__key"))


def version_coverage(ordered: list[dict], requested: list[str], limit: int) -> list[dict]:
    """The first `limit` rows with every requested version.

    Each missing version's first row is appended if there is room; else it takes the place of the last row that is not needed: one
    of a version not requested, or of a version with several rows. A version that no row has, and a limit that can't hold
    every version, are errors: nothing is left out silently.
    """
    if limit < len(set(requested)):
        raise ValueError(f"{limit} rows can't hold {len(set(requested))} versions")
    kept, rest = list(ordered[:limit]), ordered[limit:]
    for version in requested:
        if any(r["version"] == version for r in kept):
            continue
        found = next((r for r in rest if r["version"] == version), None)
        if found is None:
            raise LookupError(f"no evidence for release {version}")
        if len(kept) < limit:
            kept.append(found)
            continue
        versions = [r["version"] for r in kept]
        kept[next(i for i in range(len(kept) - 1, -1, -1) if versions[i] not in requested or versions.count(versions[i]) > 1)] = found
    return kept


def cover_versions(ranked: DataFrame, requested: list[str], limit: int, query: str = "query") -> DataFrame:
    """version_coverage of every query's candidates (columns rank and version), with place (1, 2, ...). Candidates are a top-k, so a group is bounded. A query without evidence for a requested version ends the job with an error."""
    schema = ranked.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = version_coverage(pdf.sort_values("rank").to_dict("records"), requested, limit)
        return pd.DataFrame(rows, columns=pdf.columns).assign(place=range(1, len(rows) + 1))

    return ranked.groupBy(query).applyInPandas(pick, f"{schema}, place int")
