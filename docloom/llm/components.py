"""Connected components of an edge table by rounds of smallest neighbours and shortcuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, settle


def components(links: DataFrame, settle: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """(id, comp) for each id in links (a, b): the smallest id that it reaches. No id is compared with more than its own links.

    Every round takes the smallest label of the neighbours and then the label of that label (as union-find shortens its
    paths), so chains shrink by powers. Labels are written to the shared folder after each round, and the result by settle.
    """
    links = links.select("a", "b").where("a <> b")
    with scratch(links.sparkSession, "components") as work:
        edges = work(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = work(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
        while True:
            near = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
            lower = work(labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "lower")
            jump = lower.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
            after = work(lower.join(jump, "comp").select("id", F.col("next").alias("comp"), (F.col("next") != F.col("old")).alias("moved")), "labels")
            work.drop([labels, lower])
            labels = after
            if labels.where("moved").isEmpty():
                return settle(labels.select("id", "comp"), "components")
