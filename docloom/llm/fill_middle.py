"""Fill-in-the-middle examples: a text is cut at two token bounds drawn from its id, and its middle is moved to the end.

Tokens come from the Split pre-tokenizer of the tokenizers library with isolated matches of a regular expression, so nothing is
trained: their offsets are code points, their number is n, and the offsets at the two drawn ranks give the slices. Python returns two
places a text; everything else is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token is a word with the blanks before it, or the blanks at the end. Possessive, so that no run of blanks is tried again.
TOKEN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
#: Characters that the library gets at a time; a text is cut only behind a word before a blank, where every token list has a bound.
STRETCH = 200_000
_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def token_ends(split: Callable[[str], list], text: str, stretch: int = STRETCH) -> np.ndarray:
    """Code points before the end of each token."""
    parts, start = [np.zeros(0, np.int64)], 0
    while start < len(text):
        cut = _WORD_END.search(text, start + stretch - 1) if start + stretch < len(text) else None
        end = cut.end() if cut else len(text)
        parts.append(np.fromiter((start + at[1] for _, at in split(text[start:end])), np.int64))
        start = end
    return np.concatenate(parts)


def cut_places(stretch: int = STRETCH) -> Callable[[Column, Column, Column], Column]:
    """A column function: text and two draws give n and the code points before the end of the prefix and of the middle."""
    kind = T.StructType([T.StructField(x, T.LongType(), False) for x in ("n", "prefix_end", "middle_end")])

    @F.arrow_udf(kind)
    def places(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(TOKEN), "isolated").pre_tokenize_str
        out = np.zeros((3, len(text)), np.int64)
        for i, (x, a, b) in enumerate(zip(text, first.to_pylist(), second.to_pylist())):
            ends = token_ends(split, x.as_py(), stretch)
            n = len(ends)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out[:, i] = n, ends[low - 1] if low else 0, ends[high - 1] if high else 0
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix_end", "middle_end"])

    return places


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of 8 hexadecimal digits of sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _check(marks: Sequence[str]) -> None:
    """Marks can be found again only if none is empty and no end of one begins another."""
    overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
    if len(set(marks)) != 3 or not all(marks) or overlap or any(a in b for a in marks for b in marks if a != b):
        raise ValueError("marks must be three different strings of which none is within another or begins where one ends")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80, marks: Sequence[str] = MARKS, stretch: int = STRETCH) -> DataFrame:
    """For each row: doc_id, n (tokens), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    rate: of 100 texts, how many are cut; suffix_first: of 100 of these, how many put the suffix first. Texts without a character and those
    that hold a mark are plain. psm: prefix, suffix, middle, each behind its mark; spm: suffix, prefix, middle. Null texts are empty; texts of
    any length are read whole; a null id draws as an empty one, and rows that repeat an id draw alike. Other columns are not read, whatever
    their names. An empty table gives no rows.
    """
    _check(marks)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), cut_places(stretch)(F.col("text"), h1, h2).alias("at"))
    moved = F.col("form") != "plain"
    begin, end = F.col("at.prefix_end").cast("int"), F.col("at.middle_end").cast("int")
    slices = {"prefix": F.substring("text", F.lit(1), begin), "middle": F.substring("text", begin + 1, end - begin), "suffix": F.substring("text", end + 1, F.length("text"))}
    parts = cut.select("doc_id", F.col("at.n").alias("n"), "form", *(F.when(moved, x).alias(k) for k, x in slices.items()), F.when(~moved, F.col("text")).alias("plain"))
    p, s, m = (F.concat(F.lit(x), F.col(k)) for x, k in zip(marks, ("prefix", "suffix", "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("plain"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text before it was cut, read back from an example's output and form."""
    first = {x: F.locate(x, output) for x in marks}
    p, s, m = marks

    def between(mark: str, until: str | None) -> Column:
        begin = first[mark] + len(mark)
        return F.substring(output, begin, (first[until] if until else F.length(output) + 1) - begin)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
