"""Answers and failures of services, lessons, copies of rejected files, and dense search in several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, dense, faults, lessons, vectors
from docloom.sources import mirrors


def test_schema_names_every_fault(spark):
    table = spark.createDataFrame([], "id bigint, embedding array<float>")
    assert vectors.require_schema(table, {"id": "bigint", "embedding": "array<float>"}) is table
    with pytest.raises(ValueError, match="id: bigint, not string; url: missing, not string"):
        vectors.require_schema(table, {"id": "string", "url": "string"})


def test_vector_faults(spark):
    batches = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1), (5, 2)], "batch int, expected int")
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [1.0, 2.0]), (4, 0, None), (5, 0, [1.0]), (5, 1, None)]
    found = vectors.vector_faults(batches, spark.createDataFrame(rows, "batch int, position int, vector array<double>"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 2, 1, "count", None, None), (3, 1, 0, "count", None, None), (4, 1, 1, "null", 0, None), (5, 2, 2, "dimension", 0, 1)]
    assert vectors.vector_faults(batches.limit(0), spark.createDataFrame(rows, "batch int, position int, vector array<double>"), 2).count() == 0


def test_declared_order(spark):
    rows = [
        ("whole", 0, 1, [1.0]), ("whole", 1, 0, [2.0]), ("own", 0, None, [1.0]), ("own", 1, None, [2.0]), ("twice", 0, 1, [1.0]), ("twice", 1, None, [2.0]), ("twice", 2, 9, [3.0]),
        ("far", 0, -1, [1.0]), ("short", 0, 0, [1.0]), ("empty", 0, 0, []), ("null", 0, 0, None),
    ]
    entries = spark.createDataFrame(rows, "response string, entry int, index int, vector array<double>")
    responses = spark.createDataFrame([("whole", 2), ("own", 2), ("twice", 3), ("far", 1), ("short", 3), ("empty", 1), ("null", 1), ("none", 1)], "response string, expected int")
    found = {r["response"]: (r["fault"], r["at"], r["vectors"]) for r in vectors.declared_order(responses, entries).collect()}
    assert found == {
        "whole": (None, None, [[2.0], [1.0]]), "own": (None, None, [[1.0], [2.0]]), "twice": ("duplicate", 1, None), "far": ("bounds", 0, None), "short": ("missing", 1, None),
        "empty": ("empty", 0, None), "null": ("empty", 0, None), "none": ("none", None, None),
    }


@pytest.mark.parametrize(
    "status, message, timed_out, category, disposition",
    [
        ("RESOURCE_EXHAUSTED", "429", False, faults.UNKNOWN, "TRANSIENT"),
        ("UNAVAILABLE", None, False, faults.CONNECTION, "TRANSIENT"),
        (None, "Page NOT FOUND, 401", False, faults.NOT_FOUND, "PERMANENT"),
        (None, "too many requests", True, faults.RATE_LIMITED, "TRANSIENT"),
        (None, None, True, faults.CONNECTION, "TRANSIENT"),
        (None, "embedding provider", False, faults.EMBEDDING, "PERMANENT"),
        (None, "provider", None, faults.UNKNOWN, "PERMANENT"),
    ],
)
def test_failures(spark, status, message, timed_out, category, disposition):
    row = spark.createDataFrame([(status, message, timed_out)], "s string, m string, t boolean")
    found = row.select(faults.error_category(F.col("s"), F.col("m"), F.col("t")), faults.disposition(F.col("s"), F.col("t"))).first()
    assert tuple(found) == (category, disposition)


def test_notes(spark):
    row = spark.createDataFrame([("NONE", 0, 0), ("MIXED_QUALITY", 3, 1)], "level string, n int, high int")
    notes = [r[0] for r in row.select(faults.search_note(F.col("level"), F.col("n"), F.col("high"))).collect()]
    assert notes[1] == "Found 3 documents (1 high-quality) via search. Some results may be less relevant."
    one = spark.range(1)
    assert one.select(faults.noted_prompt(F.lit("core"), F.lit(""), F.lit("low"))).first()[0] == "core"
    assert one.select(faults.noted_prompt(F.lit("core"), F.lit(notes[0]), F.lit("low"))).first()[0] == f"core\n\nSEARCH CONTEXT: {notes[0]}"
    assert one.select(faults.noted_prompt(F.lit("core"), F.lit(notes[1]), F.lit("low"))).first()[0].endswith("relevant.\nlow")


def test_a_release_without_documents_is_an_error(spark):
    rows = spark.createDataFrame([("java", ["a"], ["21", "8"]), ("go", ["b"], ["8"]), ("java", ["c"], None)], "technology string, doc_sets array<string>, versions array<string>")
    scoped = lessons.lesson_scopes(rows.where("technology = 'go' OR versions IS NULL"), {"21": "java21"}, "java")
    assert sorted(r["doc_sets"] for r in scoped.collect()) == [["b"], ["c"]]
    with pytest.raises(Exception, match="no documents of release 8"):
        lessons.lesson_scopes(rows, {"21": "java21"}, "java").collect()


def test_copies_of_rejected_files(spark):
    rows = spark.createDataFrame([("/d/a/x.html", "one"), ("/d/a/x.html", "two"), ("/e/x.html", "one"), ("/f/x.html", "one"), ("/d/.rc", "")], "path string, content string")
    copies = {r["inspection_path"].replace(r["fingerprint"], "#"): r["files"] for r in lessons.quarantine(rows, "/d/").where("content <> 'two'").collect()}
    assert copies == {".quarantine/a/x.#.html": 1, ".quarantine/x.#.html": 2, ".quarantine/.rc.#": 1}


@pytest.mark.parametrize("keep_self", [True, False])
def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch, keep_self):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(dense, "SCORE_BYTES", 2000)
    values = np.random.default_rng(5).integers(-2, 3, (120, 4)).astype(float)  # many ties
    data = [(i, v.tolist()) for i, v in enumerate(values)] + [(900, None), (901, [1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = dense.dense_top_k(rows, rows.where("vec_id < 120"), 5, keep_self=keep_self)
    unit = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 6) + 0.0
    want = {(q, k, r + 1) for q in range(120) for r, k in enumerate(sorted((k for k in range(120) if keep_self or k != q), key=lambda k: (-scores[q, k], k))[:5])}
    assert {(r["query"], r["vec_id"], r["rank"]) for r in found.collect()} == want


@pytest.mark.parametrize("span", [(0, 299), (100, 150), (7, 7)])
def test_chunk_numbers_by_ranges(spark, span):
    rows = [("hot" if i % 3 else None, i, c) for i in range(300) for c in range(i % 4)] + [("hot", None, 0), ("one", 5, 0)]
    chunks = spark.createDataFrame(rows, "source string, doc_id long, chunk int")
    whole = chunking.global_chunk_index(chunks, "source", "doc_id", "chunk").collect()
    cut = chunking.global_chunk_index(chunks, "source", "doc_id", "chunk", span=span, pieces=8)
    assert cut.columns == [*chunks.columns, "global_index"]
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole))


def test_published_identities(spark):
    rows = [
        ("good", "<meta name=version content=' 25 '><p>Java <i>25</i></p>", True), ("good", "<meta name=VERSION content=25>", False), ("good", None, None),
        ("mixed", "<meta name=version content=25>", True), ("mixed", "<meta name=version content=24>", False), ("bare", "<style>Java 25</style>Java", True), ("elsewhere", "Java 25", False),
    ]
    pages = spark.createDataFrame(rows, "mirror string, html string, required boolean")
    found = {r["mirror"]: tuple(r)[1:] for r in mirrors.published_identities(pages, "mirror", "html", "required", "25", "Java 25").collect()}
    assert found == {"good": ("25", "25", True, True), "mixed": ("24", "25", False, False), "bare": (None, None, False, False), "elsewhere": (None, None, False, False)}
    assert mirrors.published_identities(pages.limit(0), "mirror", "html", "required", "25", "x").count() == 0
