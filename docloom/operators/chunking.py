"""Token windows and chunk numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import tokenizer

MAX_TOKENS, OVERLAP = 900, 150


def white_space_tokens(text: Column) -> Column:
    """The default tokenizer: runs without white space. Another one is a function from a text column to an array column."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def token_windows(docs: DataFrame, tokens: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """docs' columns with chunk_index (from 0) and chunk (tokens): windows of max_tokens that start every max_tokens - overlap.

    The last window is the first that reaches the end. Rows without tokens have no chunk.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("0 <= overlap < max_tokens")
    step, n = max_tokens - overlap, F.size("__tokens")
    count = F.when(n == 0, 0).when(n <= max_tokens, 1).otherwise(F.ceil((n - max_tokens) / step) + 1).cast("int")
    # sequence(1, 0) would run backwards.
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = docs.withColumn("__tokens", tokens).withColumn("chunk_index", F.explode(starts))
    return cut.withColumn("chunk", F.slice("__tokens", F.col("chunk_index") * step + 1, F.lit(max_tokens))).drop("__tokens")


def tokenizer_windows(docs: DataFrame, path: str, text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, **options) -> DataFrame:
    """docs' columns but the text, with chunk_index (from 0), chunk (its text) and tokens: windows of a tokenizer's tokens.

    A text is encoded once, in the task that has it, and windows are slices of its bytes; no tokens are copied. Null and empty texts have no chunk.
    """
    rest = [c for c in docs.columns if c != text]
    placed = docs.withColumn("__places", tokenizer.window_places(path, F.col(text), max_tokens, overlap, **options))
    # Cut within the row, so that the exploded rows carry their own chunk and not the text.
    chunks = F.transform("__places", lambda p: F.struct(tokenizer.decoded(F.col(text), p["first"], p["bytes"]).alias("chunk"), p["tokens"].cast("long").alias("tokens")))
    return placed.select(*rest, F.posexplode(chunks).alias("chunk_index", "__chunk")).select(*rest, "chunk_index", "__chunk.chunk", "__chunk.tokens")


def keep_last_of_tokenizer(path: str, text: Column, n: int, **options) -> Column:
    """The text of the last n tokens; a text of no more as it is, and null as empty."""
    text = F.coalesce(text, F.lit(""))
    before = tokenizer.bytes_before_last(path, text, n, **options)
    return F.when(before == 0, text).otherwise(tokenizer.decoded(text, before + 1, F.octet_length(text)))


def global_chunk_index(chunks: DataFrame, key: str, *order: str, span: tuple[int, int] | None = None, pieces: int = 64) -> DataFrame:
    """With global_index: chunks of a key numbered from 0 over all its segments or pages, skipped chunks included.

    With the span (least, largest) of the first of order, a number, a key's chunks are cut into `pieces` ranges of it; each is numbered for itself,
    after the counts of those before, so that a key that holds a third of all rows is many tasks. Without it a key is one. Values beyond
    the span fall into the ranges at its ends.
    """
    if span is None:
        return chunks.withColumn("global_index", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
    low, high = span
    piece = F.floor((F.col(order[0]) - low) / F.lit(max(1, high - low + 1)) * pieces)
    # Null comes first in the order.
    placed = chunks.withColumn("__piece", F.when(F.col(order[0]).isNull(), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(pieces - 1), piece))))
    counts = placed.groupBy(F.col(key).alias("__key"), F.col("__piece").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__key").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy(key, "__piece").orderBy(*order)) - 1
    joined = placed.join(offsets, placed[key].eqNullSafe(offsets["__key"]) & (placed["__piece"] == offsets["__at"]))
    return joined.withColumn("global_index", own + F.col("__before")).drop("__piece", "__key", "__at", "__n", "__before")


def keep_last_tokens(tokens: Column, n: int) -> Column:
    """The last n tokens."""
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, F.lit(n))
