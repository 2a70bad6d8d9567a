"""Line deduplication: lines that many documents share stay in one of them only.

Lines are exploded as two 64-bit hashes of their normalised form, the distinct documents of a pair of hashes are counted, and the
places of lines over the threshold go back to their documents, where the other lines are put together again by position. Only
hashes and places are shuffled; a text moves only if it loses a line. A line of very many documents is one row a document, dealt by
document before it is counted, and AQE splits it in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, apart, scratch, settle

BLANKS = " \t\n\x0b\f\r"
LEAST_CHARS, LEAST_DOCS = 20, 3


def _keys(text: Column) -> Column:
    """The normalised lines of a text, in order. A-Z are lowered before the text is split, in one go."""
    lines = F.split(F.translate(text, UPPER, UPPER.lower()), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _row(text: Column) -> Column:
    """Tells rows that repeat an id apart; rows of one id and one text lose the same lines."""
    return F.xxhash64(text)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """For each row: doc_id, n_lines (before), n_dropped, kept (the text of the lines that stay, joined by line feeds).

    Lines end at \\n only. A line's key has the blanks at both ends stripped and A-Z lower-cased. Keys of at least least_chars code points
    that occur in at least least_docs documents lose all lines but those in the largest id that has it, where each of them stays.
    Documents are distinct ids; rows without an id are one document, before all others. A null or empty text is one empty line; a line or
    text of any length is read whole. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    with scratch(docs.sparkSession, "lines") as work:
        long_ = lambda x: F.length(x) >= least_chars
        once = rows.select("doc_id", F.explode(F.array_distinct(F.filter(_keys(F.col("text")), long_))).alias("key"))
        held = once.select("doc_id", *_hashes(F.col("key"))).distinct()
        # A null id is a document, which count() would leave out.
        common = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep_id")).where(F.col("docs") >= least_docs)
        common = work(common.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "keep_id"), "common")
        lines = rows.select("doc_id", _row(F.col("text")).alias("row"), F.posexplode(_keys(F.col("text"))).alias("pos", "key")).where(long_(F.col("key")))
        lines = lines.select("doc_id", "row", "pos", *_hashes(F.col("key")))
        _, near = apart(lines, lines["h1"], common.select("c1"))
        over = near.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        lost = over.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
        lost = settle(lost.select(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row"), "lost"), "lost-lines")
    return _without(rows, lost)


def _without(rows: DataFrame, lost: DataFrame) -> DataFrame:
    key = lambda a, b: F.xxhash64(a.cast("string"), b)
    whole, others = apart(rows, key(F.col("doc_id"), _row(F.col("text"))), lost.select(key(F.col("lost_id"), F.col("lost_row"))))
    # lost grows with the table: it is never broadcast, so that small and large tables are joined alike.
    met = others.join(lost.hint("merge"), others["doc_id"].eqNullSafe(lost["lost_id"]) & (_row(others["text"]) == lost["lost_row"]), "left")
    lines, n = F.split("text", "\n", -1), F.size(F.split("text", "\n", -1))
    # The runs of lines between two lost ones, by slices, so that the work grows with lines and lost ones, not with their product.
    bounds = F.concat(F.array(F.lit(-1)), F.coalesce("lost", F.array().cast("array<int>")), F.array(n))
    runs = met.select("doc_id", F.col("text"), lines.alias("lines"), bounds.alias("bounds"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda i: F.slice("lines", F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1)))
    cut = runs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("bounds") - 2).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    whole = whole.select("doc_id", n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    return whole.unionByName(cut)
