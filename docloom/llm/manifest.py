"""A Merkle manifest of a table: one digest for all rows, and for each row the proof that it is under it.

Rows are leaves of their source's tree and sources are leaves of the root's, both in order and 16 to a parent. Hashing is done in Pregel-style
supersteps over RDDs. Upwards, each node sends its digest to its parent, and a parent that has all of its children's hashes them and is a node
of the next superstep. Downwards, each run of siblings that gets the path above it sends every child the digests beside it and that path, until
the leaves' runs fold their own. A tree of n leaves takes log16(n) supersteps each way, whatever tree holds most rows: a message's key is its
parent, and no parent has more than 16.

A path travels once for the 16 rows of a run and never for each row, so messages are some 200 bytes a row. Leaves are hashed, sorted and
numbered as columns, and written to the shared folder before the first superstep.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, settle

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a task.
TASK_ROWS = 50_000


def leaf_digest(values: Iterable[Column]) -> Column:
    """sha256 (hexadecimal) of the values: each `-` if null, else its length in UTF-8, a colon and itself."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)), 256)


def digest(parts: Iterable[bytes]) -> bytes:
    """sha256 of digests, concatenated as hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def _deal(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _numbered(leaves: DataFrame, work: scratch) -> DataFrame:
    """leaves with place (0, 1, ... within the source) and width (the source's leaves), in the order of id and leaf.

    The table is dealt by ranges and written with each row's number in its task, so a source of any size is many tasks, and only counts
    by task and source are added up.
    """
    order = [F.asc_nulls_first(c) for c in ("source", "id", "leaf")]
    rows = work(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "leaves")
    rows = rows.withColumn("task", F.shiftright("at", 33))
    counts = work(rows.groupBy("source", "task").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")), "counts")
    counts = counts.selectExpr(
        "source AS of", "task AS in_task", "first", "coalesce(sum(rows) OVER (PARTITION BY source ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", "sum(rows) OVER (PARTITION BY source) AS width"
    )
    met = rows.join(counts, (rows["task"] == counts["in_task"]) & rows["source"].eqNullSafe(counts["of"]))
    return met.select("source", "id", "leaf", "other", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "width")


# A node is ((tree, place), (width, digest, more)), width being the number of nodes of its tree at its level; a run is the children of one
# parent: ((tree, place), (width, [(digest, more)])). A tree's top passes through the supersteps of taller trees as it is.


def _to_parent(node: tuple) -> tuple:
    (tree, place), value = node
    return (tree, place // RUN), (place % RUN, value)


def _complete(messages: Iterable[tuple]) -> tuple:
    run = [value for _, value in sorted(messages, key=lambda m: m[0])]
    return run[0][0], [(d, more) for _, d, more in run]


def _node(run: tuple) -> tuple:
    key, (width, children) = run
    return key, (-(-width // RUN), children[0][0] if width == 1 else digest(d for d, _ in children), None)


def climb(nodes: RDD, widest: int, parts: int) -> tuple[list[RDD], RDD]:
    """All supersteps up: the runs of each level, the leaves' first, and the tops of all trees, ((tree, 0), (1, digest, None)). widest: leaves of the largest tree."""
    levels = []
    while widest > 1 or not levels:
        levels.append(nodes.map(_to_parent).groupByKey(parts, _deal).mapValues(_complete))
        nodes, widest, parts = levels[-1].map(_node), -(-widest // RUN), -(-parts // RUN)
    return levels, nodes


def descend(levels: list[RDD], paths: RDD, give: Callable[[tuple, tuple, tuple], tuple]) -> RDD:
    """All supersteps down. paths: ((tree, 0), (mark, path)) of each tree's top; give(key, leaf, (mark, path)) makes a leaf's result.

    A path is the digests before and behind a node in its run, then those of its parent, and so on; marks are handed down as they are.
    """

    def send(item: tuple, lowest: bool) -> Iterator[tuple]:
        (tree, place), ((width, children), (mark, path)) = item
        for i, child in enumerate(children):
            own = (mark, path if width == 1 else (*_beside(children, i), *path))
            yield give((tree, place * RUN + i), child, own) if lowest else ((tree, place * RUN + i), own)

    for level in range(len(levels) - 1, -1, -1):
        paths = _join(levels[level], paths).flatMap(lambda item, lowest=level == 0: send(item, lowest))
    return paths


def _beside(children: Sequence[tuple], i: int) -> tuple:
    return ((b"".join(d for d, _ in children[:i]), b"".join(d for d, _ in children[i + 1 :])),)


def _join(runs: RDD, paths: RDD) -> RDD:
    """Runs with the path above each. Runs were dealt by _deal already and stay where they are."""
    parts = runs.getNumPartitions()
    both = runs.mapValues(lambda r: (0, r)).union(paths.mapValues(lambda p: (1, p)).partitionBy(parts, _deal))
    return both.groupByKey(parts, _deal).mapValues(lambda v: tuple(x for _, x in sorted(v, key=lambda m: m[0])))


def fold(node: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for before, behind in path:
        node = digest((before, node, behind))
    return node


def _proven(root: bytes, with_paths: bool) -> Callable[[tuple, tuple, tuple], tuple]:
    def give(key: tuple, leaf: tuple, above: tuple) -> tuple:
        node, (row, other) = leaf
        subroot, path = above
        proof = digest(x for pair in path for x in pair)
        folded = fold(other or node, path)
        return (row, node, subroot, root, proof, folded, *([list(path)] if with_paths else []))

    return give


def prove_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, found: dict[str, Column] | None = None, where: Column | None = None, with_paths: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """For each row, all binary: doc_id, leaf, subroot (of its source), root, proof (digest of its path), folded; with with_paths also path.

    fields: the columns that a leaf is made of, in order. path: the digests beside the row, its parent and so on to the root, as (before, behind)
    each. found: columns as they are found later, by name, for the rows of the condition where; folded is the root that these rows' leaves
    give with the siblings of docs, and equals root only if the row is unchanged.

    A source's leaves are in the order of doc_id (null first), then of the leaf, so ties and repeated rows have one order; a null source is one of its own, the
    first. Nulls in any field have a mark of their own and differ from empty ones; texts of any length are hashed whole. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    spark, later = docs.sparkSession, found or {}
    leaf = F.unhex(leaf_digest(docs[c] for c in fields))
    other = F.unhex(leaf_digest(later.get(c, docs[c]) for c in fields)) if later else F.lit(None).cast("binary")
    leaves = docs.select(docs[source].cast("string").alias("source"), docs[doc_id].alias("id"), leaf.alias("leaf"), (other if where is None else F.when(where, other)).alias("other"))
    names = ["leaf", "subroot", "root", "proof", "folded"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(n, T.BinaryType()) for n in names)])
    if with_paths:
        pair = T.StructType([T.StructField("before", T.BinaryType()), T.StructField("behind", T.BinaryType())])
        schema = schema.add("path", T.ArrayType(pair))
    with scratch(spark, "manifest") as work:
        rows = work(_numbered(leaves, work), "numbered")
        size = rows.agg(F.max("width").alias("widest"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("place") == 0).alias("sources")).first()
        if not size.rows:
            return spark.createDataFrame([], schema)
        parts, source_parts = -(-size.rows // task_rows), -(-size.sources // task_rows)
        # bytes() as rows come with bytearrays, which are no digests to compare.
        nodes = rows.rdd.map(lambda r: ((r.source, r.place), (r.width, bytes(r.leaf), (r.id, r.other and bytes(r.other)))))
        levels, tops = climb(nodes, size.widest, parts)
        # Null first, then by UTF-8 bytes.
        ordered = tops.map(lambda t: ((t[0][0] is not None, (t[0][0] or "").encode()), (t[0][0], t[1][1]))).sortByKey(numPartitions=source_parts).values().zipWithIndex()
        sources = ordered.map(lambda x, n=size.sources: ((b"", x[1]), (n, x[0][1], x[0][0])))
        source_levels, top = climb(sources, size.sources, source_parts)
        root = top.first()[1][1]
        start = top.map(lambda t: (t[0], (None, ())))
        above = descend(source_levels, start, lambda key, node, path: ((node[1], 0), (node[0], path[1])))
        proven = descend(levels, above, _proven(root, with_paths))
        return settle(spark.createDataFrame(proven, schema), "proofs")


def verify_rows(docs: DataFrame, proofs: DataFrame, root: bytes, doc_id: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """For each row of docs: doc_id and verified, whether the row as it is now is under root by a path of proofs (from prove_rows, with_paths).

    A leaf is a digest of the whole row, so a row whose leaf no proof of its id has is not verified; of rows that repeat an id and a leaf any path will do.
    """
    now = docs.select(docs[doc_id].alias("doc_id"), F.unhex(leaf_digest(docs[c] for c in fields)).alias("now"))
    kept = proofs.select(F.col("doc_id").alias("of"), "leaf", "path").dropDuplicates(["of", "leaf"])

    @F.udf("boolean", useArrow=True)
    def leads(node: bytes, path: list) -> bool:
        return path is not None and fold(bytes(node), ((bytes(x["before"]), bytes(x["behind"])) for x in path)) == root

    met = now.join(kept, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("now") == F.col("leaf")), "left")
    return met.select("doc_id", F.when(F.col("leaf").isNull(), False).otherwise(leads("now", "path")).alias("verified"))
