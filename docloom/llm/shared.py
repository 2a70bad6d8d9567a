"""Helpers of several operators: tables in the shared folder, inputs, text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without it, as in tests, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class scratch:
    """Tables that one operator needs only while it works: `with scratch(spark, name) as settle` writes them into a folder that goes at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_folder(spark, name), {}

    def __enter__(self) -> scratch:
        return self

    def __call__(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, tables: Iterable[DataFrame]) -> None:
        """Tables that nothing will read again."""
        for df in tables:
            delete(self.spark, self.paths.pop(id(df))[1])

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Bits of the filter of apart() for each key, and at most: 2**19 rows of four numbers, some 50 MB.
KEY_BITS, FILTER_BITS = 16, 27


def apart(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as two tables: rows whose key is not among keys (one long column), and the others, with few that are not either.

    The keys are marked in a bitmap of bounded size, which is broadcast, so the first table passes without a shuffle and only the second has to
    meet the keys. More keys than the bitmap is made for send more rows the second way; each row comes out once at any size.
    """
    keys, at_name, names = keys.toDF("key"), unused(docs, "at"), [unused(docs, f"bits{i}") for i in range(4)]
    bits = min(FILTER_BITS, max(10, (KEY_BITS * keys.count()).bit_length()))
    spread = lambda k: F.shiftrightunsigned(F.xxhash64(k, F.lit(bits)), 64 - bits)
    at = spread(F.col("key"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    quarter = lambda a: F.shiftright(a, 6).bitwiseAND(F.lit(3))
    marks = keys.groupBy(F.shiftright(at, 8).alias(at_name)).agg(*(F.coalesce(F.bit_or(F.when(quarter(at) == i, one)), F.lit(0).cast("long")).alias(names[i]) for i in range(4)))
    marks = settle(marks, "marks")
    place = spread(key)
    word = F.when(quarter(place) == 0, marks[names[0]]).when(quarter(place) == 1, marks[names[1]]).when(quarter(place) == 2, marks[names[2]]).otherwise(marks[names[3]])
    marked = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = docs.join(F.broadcast(marks), F.shiftright(place, 8) == marks[at_name], "left")
    columns = [docs[c] for c in docs.columns]
    return met.where(F.coalesce(~marked, F.lit(True))).select(*columns), met.where(marked).select(*columns)


def row_key(doc_id: Column, sha: Column) -> Column:
    """A row's key for apart(): by its id, or without one by its text's hash, which is only made then."""
    return F.when(doc_id.isNull(), F.xxhash64(sha)).otherwise(F.xxhash64(doc_id.cast("string")))


def drop_rows(docs: DataFrame, sha: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows of dropped, and with one of each of repeated: settled tables of (dropped_id, dropped_sha).

    sha: the hash of a row's text that they hold. It is made only for rows that may be among them, and for rows without an id.
    """
    own_key = row_key(F.col("dropped_id"), F.col("dropped_sha"))
    free, others = apart(docs, row_key(docs["doc_id"], sha), dropped.select(own_key).unionByName(repeated.select(own_key)).toDF("key"))
    name = unused(docs, "sha")
    others = others.withColumn(name, sha)
    among = lambda rows, table: rows["doc_id"].eqNullSafe(table["dropped_id"]) & (rows[name] == table["dropped_sha"])
    others = others.join(dropped, among(others, dropped), "left_anti")
    if not repeated.isEmpty():
        one = others.join(repeated, among(others, repeated), "left_semi").dropDuplicates(["doc_id", name])
        others = others.join(repeated, among(others, repeated), "left_anti").unionByName(one)
    return free.unionByName(others.drop(name))


def ascii_lower(text: Column) -> Column:
    """A-Z only; Spark's lower() would change other letters too."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
