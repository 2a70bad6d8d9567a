"""Windows, counts and tails against the tokenizer's own encode, slice and decode."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docloom import queries
from docloom.functions import tokenizer
from docloom.operators import chunking

FOLDER, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_windows(library, text, size, overlap):
    ids, out, start = library.encode_ordinary(text or ""), [], 0
    while start < len(ids):
        end = min(start + size, len(ids))
        out.append((library.decode(ids[start:end]), end - start))
        if end == len(ids):
            break
        start = end - overlap
    return out


TEXTS = ["", None, "one", "héllo wörld 😀😀😀 日本語のテキスト", "a b c " * 300, "x" * 5000, " " * 3000 + "y", "\n\n \t z", "<|endoftext|> it's we'll 123 4567 -- ?!", "é" * 999, "\u0000\u0007 ok", "👩‍👩‍👧‍👦 ñ" * 50]


def test_windows_and_tails_against_the_library(spark, library):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id int, text string, chunk_hash string")
    for size, overlap, stretch in ((7, 3, 20), (5, 0, 100_000), (900, 150, 1)):
        found = {}
        for r in chunking.tokenizer_windows(rows, PATH, max_tokens=size, overlap=overlap, stretch=stretch).collect():
            found.setdefault(r.id, []).append((r.chunk_index, r.chunk, r.tokens))
        for i, t in enumerate(TEXTS):
            assert [x[1:] for x in sorted(found.get(i, []))] == plain_windows(library, t, size, overlap), (i, size)
    tails = rows.select("id", chunking.keep_last_of_tokenizer(PATH, F.col("text"), 4).alias("tail"), tokenizer.count_tokens(PATH, F.col("text")).alias("n")).collect()
    for r in tails:
        ids = library.encode_ordinary(TEXTS[r.id] or "")
        assert (r.n, r.tail) == (len(ids), (TEXTS[r.id] or "") if len(ids) <= 4 else library.decode(ids[-4:]))
    assert chunking.tokenizer_windows(rows.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        chunking.tokenizer_windows(rows, PATH, max_tokens=5, overlap=5)


def test_stretches_do_not_change_tokens(library):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "'s", "é", "1", ".", "B", "<|"]) for _ in range(rng.randrange(80)))
        lengths = [len(library.decode_single_token_bytes(x)) for x in library.encode_ordinary(text)]
        bounds = [sum(lengths[:i]) for i in range(len(lengths) + 1)]
        assert all(list(tokenizer.token_bounds(PATH, text, stretch=k)) == bounds for k in (1, 5, 1000))


def test_all_documents(spark, library):
    found = {(r.doc_id, r.chunk_index): (r.tokens, r.chunk_hash, r.n_tokens, r.tail_hash) for r in queries.QUERIES["e2_h13_h14_tokenizer_windows"](spark, FOLDER).collect()}
    sha, want = lambda s: hashlib.sha256(s.encode()).hexdigest(), {}
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        tail = (d.text or "") if len(ids) <= 20 else library.decode(ids[-20:])
        for k, (chunk, n) in enumerate(plain_windows(library, d.text, 900, 150)):
            want[d.doc_id, k] = (n, sha(chunk), len(ids), sha(tail))
    assert found == want and len(want) > 200
