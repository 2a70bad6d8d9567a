"""Queries over all terms of a document, on documents whose rare word is behind 256 more frequent ones."""

import hashlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom import queries

#: By their ids of three releases (24, 21, 25) and collections (articles, docs, pdfs).
LONG = [4, 6, 11]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("terms")
    often = " ".join(f"w{i:03} w{i:03}" for i in range(300))
    docs = [(i, f"{often} zebra" if i in LONG else f"plain words {i}", "en", f"src{i % 4}") for i in range(1, 14)]
    columns = dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*docs))))
    pq.write_table(pa.table(columns | {"n_chars": [len(t) for t in columns["text"]]}), f"{path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1], "text": ["Zebra?", "plain zebra w000"]}), f"{path}/benchmark.parquet")
    vectors = pa.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": [0, 1, 20], "embedding": vectors, "label": pa.array([0, 1, 2], pa.int32())}), f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def result(spark, folder):
    """Rows of a query, which are those of its SQL."""
    duck = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")

    def of(name):
        got = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
        cursor = duck.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        plain = lambda r: sorted((k, round(v, 8) if isinstance(v, float) else v) for k, v in r.items())
        assert sorted(map(str, map(plain, got))) == sorted(str(plain(dict(zip(names, r)))) for r in cursor.fetchall())
        return got

    return of


def test_the_most_frequent_terms_are_256(result):
    assert sum(r["doc_id"] == 4 for r in result("d1_f7_top_terms")) == 256


def test_idf_has_all_terms(result):
    df = {r["term"]: r["df"] for r in result("d14_idf")}
    assert df["zebra"] == df["w299"] == 3 and len(df) == 300 + 6


def test_a_search_finds_rare_terms_of_long_documents(result):
    found = [(r["item_id"], r["rank"], r["doc_id"]) for r in result("i3_sparse_top_k")]
    assert sorted(x for x in found if x[0] == 0) == [(0, 1, 4), (0, 2, 6), (0, 3, 11)]


def test_releases_have_documents_of_rare_terms(result):
    assert sorted((r["scope"], r["rank"], r["doc_id"]) for r in result("c15_i6_version_scopes") if r["item_id"] == 0) == [("21", 1, 6), ("25", 1, 11)]


def test_hashes_are_of_documents_of_rare_terms(result, folder):
    text = dict(zip(*(pq.read_table(f"{folder}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    parts = [part.encode() for i in LONG for part in (str(i), text[i], "source", f"src{i % 4}")]
    whole = b"".join(len(part).to_bytes(4) + part for part in parts)
    assert {r["item_id"]: r["hash"] for r in result("d11_h5_documents_hash")}[0] == hashlib.sha256(whole).hexdigest()


def test_fused_rankings_have_documents_of_rare_terms(result):
    assert {4, 6, 11} < {r["doc_id"] for r in result("e1_i4_hybrid") if r["query"] == 0}


def test_releases_are_covered_by_rare_terms(result):
    assert sorted((r["doc_id"], r["version"]) for r in result("e8_version_coverage") if r["query"] == 0) == [(4, "24"), (6, "21"), (11, "25")]


def test_collections_have_documents_of_rare_terms(result):
    found = [(r["rank"], r["doc_id"], r["collection"]) for r in result("i5_collections") if r["item_id"] == 0]
    assert sorted(found) == [(1, 4, "articles"), (2, 6, "docs"), (3, 11, "pdfs")]


def test_citations_of_rare_terms(result):
    found = [(r["scope"], r["rank"], r["doc_id"]) for r in result("i7_citation_search") if r["item_id"] == 0]
    assert sorted(found) == [("all", 1, 6), ("all", 2, 11), ("new", 1, 11)]


def test_documents_of_rare_terms_are_cut(result):
    found = [(r["rank"], r["doc_id"], r["truncated"]) for r in result("f3_f5_document_caps") if r["item_id"] == 0]
    assert sorted(found) == [(1, 4, True), (2, 6, True), (3, 11, True)]
