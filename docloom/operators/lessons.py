"""Lessons: what is searched for one and where, what of it is evidence, and where rejected files are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts that a lesson's hints are made from, at most.
MOST_SNIPPETS = 6


def lesson_query(technology: Column, title: Column, summary: Column, keywords: Column) -> Column:
    """What is searched for a lesson: technology. title. summary keyword, keyword. Parts that are null, and a blank technology, are left out."""
    part = lambda x, end: F.coalesce(F.concat(x, F.lit(end)), F.lit(""))
    named = F.when(F.trim(technology) != "", F.concat(technology, F.lit(". "))).otherwise("")
    return F.trim(F.concat(named, part(title, ". "), part(summary, " "), F.coalesce(F.array_join(keywords, ", "), F.lit(""))))


def lesson_scopes(lessons: DataFrame, api_sets: dict[str, str], api_technology: str) -> DataFrame:
    """lessons (technology, doc_sets, versions: releases that are asked for) with doc_sets to search: those of the releases, in their order, if the
    lesson is of api_technology and names any; else its own. A release without a doc set ends the job with an error."""
    sets = F.create_map(*(F.lit(x) for pair in api_sets.items() for x in pair))
    own = (F.coalesce(F.col("technology"), F.lit("")) != api_technology) | (F.coalesce(F.size("versions"), F.lit(0)) <= 0)
    found = lambda v: F.coalesce(F.element_at(sets, v), F.raise_error(F.concat(F.lit("no documents of release "), v)))
    return lessons.withColumn("doc_sets", F.when(own, F.col("doc_sets")).otherwise(F.transform("versions", found)))


def snippets(ranked: DataFrame, lesson: str, rank: str, most: int = MOST_SNIPPETS) -> DataFrame:
    """The first `most` rows of each lesson by rank. Each task cuts its own rows before the shuffle."""
    place = F.row_number().over(W.partitionBy(lesson).orderBy(rank))
    return ranked.withColumn("place", place).where(F.col("place") <= most)


def quarantine(rejected: DataFrame, root: str, folder: str = ".quarantine", path: str = "path", content: str = "content") -> DataFrame:
    """(inspection_path, fingerprint, content, files): a copy of each rejected file; the files themselves stay where they are.

    A copy lies below folder as its file lies below root, a file from elsewhere at its top, and the content's SHA-256 stands in its name before the
    last dot, unless that is the first character. Files of one name and content share a copy. Paths are absolute and have no `..`.
    """
    root = root.rstrip("/") + "/"
    below = F.when(F.col(path).startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    parent, name = F.regexp_extract(below, "^(.*/)?[^/]*$", 1), F.regexp_extract(below, "([^/]*)$", 1)
    stem, ending = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    fingerprint = F.sha2(F.col(content), 256)
    named = F.when(stem == "", F.concat(name, F.lit("."), fingerprint)).otherwise(F.concat(stem, F.lit("."), fingerprint, ending))
    copies = rejected.select(F.concat(F.lit(folder + "/"), parent, named).alias("inspection_path"), fingerprint.alias("fingerprint"), F.col(content).alias("content"))
    return copies.groupBy("inspection_path", "fingerprint").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("files"))
