"""Exact deduplication by deterministic block naming.

A document's normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered;
then pairs of adjacent numbers are sorted and numbered, and so on until one number is left per document. Equal texts,
and only those, end with an equal number at an equal level.

Blocks are dealt by a 64-bit hash, which only routes: the distinct contents of every hash are compared in full, and
where a hash has several of them they are numbered apart. A text crosses the network once at most, after map-side
removal of copies, so a group of copies of any size never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, drop_rows, scratch, settle

BLOCK_BYTES = 32768
#: Names are numbers within ranges of the hash: 2**RANGE_BITS ranges of 2**(63 - RANGE_BITS) names.
RANGE_BITS = 22


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """name: an integer for each row of distinct keys with column h, by sorting; the same for the same keys however they are dealt."""
    rank = F.row_number().over(W.partitionBy("slot").orderBy("h", *order))
    slotted = keys.withColumn("slot", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    return slotted.withColumn("name", F.shiftleft("slot", 63 - RANGE_BITS) + rank).drop("slot")


def _name_blocks(blocks: DataFrame, work: scratch) -> DataFrame:
    """(doc, pos, blocks, n, name) for settled (doc, pos, blocks, h, block)."""
    contents = blocks.select("h", "block").distinct()
    routes = work(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")), "block-routes")
    parts = blocks.select("doc", "pos", "blocks", F.lit(1).cast("long").alias("n"), "h")
    names = _numbered(routes.where("contents = 1").select("h"), [])
    named = parts.join(names, "h").drop("h")
    clashes = routes.where("contents > 1").select("h")
    if clashes.isEmpty():
        return named
    # Hashes of several contents: these are numbered by content, after the names of their range.
    several = contents.join(clashes, "h", "left_semi")
    apart = _numbered(several, ["block"]).withColumn("name", -F.col("name"))
    whole = blocks.select("doc", "pos", "blocks", F.lit(1).cast("long").alias("n"), "h", "block")
    return named.unionByName(whole.join(apart, ["h", "block"]).drop("h", "block"))


def _name_pairs(parts: DataFrame, work: scratch) -> DataFrame:
    """One level up: half the positions, each with the name of a pair. A last name without a neighbour is paired with 0."""
    even = F.col("pos") % 2 == 0
    pairs = work(
        parts.groupBy("doc", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),
            F.sum(F.when(even, F.col("n"))).alias("n"),
        ),
        "name-pairs",
    )
    keys = pairs.select("a", "b").distinct().withColumn("h", F.xxhash64("a", "b"))
    return pairs.join(_numbered(keys, ["a", "b"]).drop("h"), ["a", "b"]).drop("a", "b")


def block_names(texts: DataFrame, work: scratch, block_bytes: int = BLOCK_BYTES, route: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(doc, level, name, n) for (doc, data): docs have equal level and name if and only if their data are equal.

    doc: a key that rows share only if their data are equal; n: the number of its rows. data: binary, not null. The result reads tables of work.
    route: the hash by which blocks are dealt; any function gives the same classes.
    """
    count = F.greatest(F.lit(1), F.ceil(F.length("data") / block_bytes)).cast("int")
    cut = texts.select("doc", "data", count.alias("blocks"), F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    block = F.substring("data", F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    blocks = work(cut.select("doc", "pos", "blocks", block.alias("block")).withColumn("h", route("block")), "blocks")
    parts, done, level = work(_name_blocks(blocks, work), "names-0"), [], 0
    work.drop([blocks])
    while True:
        done.append(parts.where("blocks = 1").select("doc", F.lit(level).alias("level"), "name", "n"))
        parts = parts.where("blocks > 1")
        if parts.isEmpty():
            break
        level += 1
        parts = work(_name_pairs(parts, work), f"names-{level}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc", "level", "name").agg(F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, route: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """For each row: doc_id, text_sha256, keep_id, group_size, kept; for repeated rows of one id and text also copy (1, 2, ...).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest doc_id stays, of rows that
    repeat an id and a text one; a row without an id stays only if all of its group are without. Null texts count as empty,
    and all empty texts are copies of each other. An empty table gives no rows. Other columns are not read.
    """
    data = F.coalesce(ascii_lower(F.col(text)), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), data.alias("data"))
    rows = rows.select(F.struct("id", F.sha2("data", 256).alias("sha")).alias("doc"), F.col("data").cast("binary").alias("data"))
    with scratch(docs.sparkSession, "blocks") as work:
        named = settle(block_names(rows, work, block_bytes, route), "doc-names")
    # Written first, so that in the join a name of very many documents can be split.
    groups = settle(named.groupBy("level", "name").agg(F.max("doc.id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    each = named.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select(
        F.col("doc.id").alias("doc_id"),
        F.col("doc.sha").alias("text_sha256"),
        "keep_id",
        "group_size",
        (F.col("doc.id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "copy",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that exact_dedup keeps; of rows that repeat an id and a text, one of them. Texts are not shuffled but of rows that may be dropped."""
    gone = exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha"), "copy")
    gone = settle(gone, "dropped")
    dropped = gone.where("copy = 1").drop("copy")
    sha = F.sha2(F.coalesce(ascii_lower(docs["text"]), F.lit("")), 256)
    return drop_rows(docs, sha, dropped, settle(gone.where("copy > 1").drop("copy").distinct(), "repeated"))
