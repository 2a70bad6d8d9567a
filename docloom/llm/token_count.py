"""Token counts of whole texts; huge ones are cut into overlapping chunks and spliced where both sides provably agree.

The tokenizer splits a text left to right into pieces (pre-tokens) and merges bytes within a piece. What follows a piece
boundary depends only on the text after it, so if a place is a boundary in the chunk on its left, with text to look ahead, and in
the chunk on its right, both agree from there on. A chunk is therefore counted from its splice with the chunk before
to its splice with the next. Where an overlap has no such place (one piece spans it), all chunks of that document get
overlaps four times as wide, in the end the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Characters of a text that is not cut, of a chunk's own part, of the first overlap, and of what a boundary must have after it.
WHOLE, CHUNK, OVERLAP, AHEAD = 16_000, 8_000, 500, 64
#: Pieces whose counts a task keeps, and characters of a piece that is kept.
MOST_KEPT, LONGEST_KEPT = 300_000, 32

# How a byte-level pre-tokenizer splits a text, and characters beyond those on which any Unicode version agrees.
PIECE = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
UNUSUAL = regex.compile(r"[^ -~\t\n\r\u00C0-\u017F]")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class _Kept(dict):
    """Tokens of pieces, each encoded when first met."""

    def __init__(self, encoded: Callable[[str], int]):
        self.encoded = encoded

    def __missing__(self, piece: str) -> int:
        n = self.encoded(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = n
        return n


def _counter(tokenizer) -> Callable[[str], int]:
    """Tokens of a text. A byte-level tokenizer merges within a piece only, so its counts are sums over pieces, and a piece that comes again
    is not encoded again. Texts with special strings or unusual characters are encoded as they are, and so are all of other tokenizers."""
    form = json.loads(tokenizer.to_str())
    split = form["pre_tokenizer"] or {}
    by_piece = form["normalizer"] is None and form["model"]["type"] == "BPE" and not form["model"].get("dropout") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    special = [x["content"] for x in form["added_tokens"]]

    def encoded(text: str) -> int:
        return len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    kept = _Kept(encoded)

    def count(text: str) -> int:
        if not by_piece or UNUSUAL.search(text) or any(x in text for x in special):
            return encoded(text)
        if len(kept) > MOST_KEPT:
            kept.clear()
        return sum(map(kept.__getitem__, PIECE.findall(text)))

    return count


def _count_whole(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(_tokenizer(path))
        for batch in batches:
            tokens = [of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(batch.columns)) if i != 1), pa.array(tokens, pa.int64())], [*(x for x in batch.schema.names if x != "text"), "n_tokens"])

    return count


def _count_chunks(path: str, chunk: int, ahead: int):
    """For each chunk its boundaries in the overlap with the chunk before and in that with the next: places in the text, and tokens of the chunk before each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            out = []
            for text, start, overlap in zip(*(batch.column(i).to_pylist() for i in (2, 1, 3))):
                x = tokenizer.encode(text, add_special_tokens=False)
                at, first = [], -1
                # word_ids: the piece of each token; a special string in the text has none and is a piece of its own.
                for i, (word, (a, _)) in enumerate(zip(x.word_ids, x.offsets)):
                    if word is None or word != first:
                        at.append((start + a, i))
                    first = -1 if word is None else word
                end = start + len(text) - ahead
                left = [p for p in at if p[0] < start + overlap]
                right = [p for p in at if start + chunk <= p[0] <= end]
                out.append((len(x.ids), [p[0] for p in left], [p[1] for p in left], [p[0] for p in right], [p[1] for p in right]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.list_(pa.int64())] * 4))] if out else [pa.array([], t) for t in (pa.int64(), *[pa.list_(pa.int64())] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", "start", "n", "left_at", "left_n", "right_at", "right_n"])

    return count


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, whole: int = WHOLE, chunk: int = CHUNK, overlap: int = OVERLAP, ahead: int = AHEAD) -> DataFrame:
    """For each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: the tokenizer's file, the same on every machine. Tokens are those of tokenizers.encode without added special tokens. Texts of more
    than `whole` characters are cut into chunks, which are dealt over all tasks; equal texts are counted once. Null and empty texts have 0.
    Rows that repeat an id are counted each; other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    kind = docs.schema[doc_id].dataType.simpleString()
    short = rows.where(F.length("text") <= whole).select("doc_id", "text", n_bytes).mapInArrow(_count_whole(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    over = (F.col("n_tokens") > limit).alias("over_limit")
    # Huge texts are keyed by their content: rows of equal texts have equal counts.
    texts = rows.where(F.length("text") > whole).select("doc_id", "text", n_bytes, F.sha2("text", 256).alias("doc"))
    huge = settle(texts.select("doc_id", "n_bytes", "doc"), "huge")
    if huge.isEmpty():
        return short.select("doc_id", "n_bytes", "n_tokens", over)
    open_, counted, width = texts, [], overlap
    while True:
        pieces = F.greatest(F.lit(1), F.ceil((F.length("text") - width) / chunk)).cast("int")
        # Cut once, in parts that follow one another; a chunk is a part and the beginning of the text after it.
        parts = open_.select("doc", pieces.alias("pieces"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("parts"))
        at = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
        joined = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.concat(at(i), F.substring(at(i + 1), 1, width)))
        chunks = parts.select("doc", F.posexplode(joined).alias("i", "text")).select("doc", (F.col("i") * chunk).cast("long").alias("start"), "text", F.lit(width).alias("overlap"))
        lists = "left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
        found = settle(chunks.dropDuplicates(["doc", "start"]).mapInArrow(_count_chunks(path, chunk, ahead), f"doc string, start long, n long, {lists}"), "chunks")
        before = found.select("doc", (F.col("start") + chunk).alias("start"), "right_at", "right_n")
        pairs = found.select("doc", "start", "n", "left_at", "left_n").join(before, ["doc", "start"], "left")
        # The first place that both sides of an overlap have; null if none.
        spliced = pairs.withColumn("at", F.array_min(F.array_intersect("left_at", "right_at")))
        to_splice, from_splice = (F.element_at(n, F.array_position(at, F.col("at")).cast("int")) for at, n in (("right_at", "right_n"), ("left_at", "left_n")))
        sums = spliced.groupBy("doc").agg(
            (F.max_by("n", "start") + F.coalesce(F.sum(F.when(F.col("at").isNotNull() & (F.col("start") > 0), to_splice - from_splice)), F.lit(0))).alias("n_tokens"),
            F.max((F.col("start") > 0) & F.col("at").isNull()).alias("torn"),
        )
        sums = settle(sums, "spliced")
        counted.append(sums.where("NOT torn").select("doc", "n_tokens"))
        torn = sums.where("torn").select("doc")
        if torn.isEmpty():
            break
        open_, chunk, width = texts.join(torn, "doc", "left_semi"), 4 * chunk, 4 * width
    counts = counted[0]
    for x in counted[1:]:
        counts = counts.unionByName(x)
    long_ = huge.join(counts, "doc").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_).select("doc_id", "n_bytes", "n_tokens", over)
