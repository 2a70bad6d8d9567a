import pytest
from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.operators import index, quality, registry, search
from docloom.plans.constraints import Constraint


def test_a_release_without_evidence_is_an_error(spark):
    scored = spark.createDataFrame([(1, i, 1.0 / i, v) for i, v in enumerate(["21", "21", "24", "25"], 1)], "q int, id int, score double, version string")
    scopes = search.fan_out(Constraint(doc_versions=["21", "24"]), ["24", "21"])
    found = search.search_scopes(scored, scopes, "q", "id", 1, version="version")
    assert {(r.scope, r.id, r.rank) for r in found.collect()} == {("21", 1, 1), ("24", 3, 1)}
    assert search.require_versions(found, "q", ["21", "24"]).count() == 2
    with pytest.raises(LookupError):
        search.require_versions(found, "q", ["21", "25"])
    with pytest.raises(ValueError):
        search.fan_out(Constraint(doc_versions=["21"]), ["25"])
    assert search.fan_out(Constraint(), []) == {"": Constraint()}


def test_member_questions_need_member_evidence():
    api = {"java25"}
    assert search.requires_member_evidence("What is List.of(E)?", Constraint(doc_sets=["java25"]), api)
    assert not search.requires_member_evidence("What is List.of(E)?", Constraint(doc_sets=["books"]), api)
    assert not search.requires_member_evidence("What is a list?", Constraint(doc_sets=["java25"]), api)


def test_citations_of_hand_made_rows(spark):
    rows = [
        (1, 1, "https://x.org/a#f", "t", "", " one "), (1, 2, "https://x.org/a", "t", "of()", "two"), (1, 3, "https://x.org//a#of()", "t", None, None), (1, 4, "file:///d/a.html", "t", "", "x"), (1, 5, "file:///d/b.html", "t", "", "x"), (1, 6, "file:///d/a.html#z", "t", "", "x"),
        (1, 7, None, "t", None, "x"), (1, 8, " ", "t", None, "x"), (1, 9, "file:///w/data/docs/m/c.html", "t", "", "y" * 501), (1, 10, "/x//y.html", "t", "", "y" * 500), (1, 11, "file:///w/data/docs/books/a.pdf", "t", "", "x"), (2, 1, "https://x.org/a", None, None, "bad"), (None, 1, "https://x.org/a", "t", None, "x"), (None, 2, "https://x.org/a", "t", None, "x"), (1, 12, "", "t", "of()", "x"),
    ]
    table = spark.createDataFrame(rows, "q int, at int, url string, title string, anchor string, text string")
    sources = spark.createDataFrame([("m", "https://m.org/")], "mirror string, base_url string")
    kept, failures = search.citations(table, ["q"], "at", sources, failed=F.col("title").isNull())
    found = {(r.q, r["at"]): (r.url, r.anchor, r.snippet) for r in kept.collect()}
    assert found == {
        (1, 1): ("https://x.org/a", "f", " one "), (1, 2): ("https://x.org/a", "of()", "two"), (1, 4): (search.REDACTED, "", "x"), (1, 5): (search.REDACTED, "", "x"), (1, 7): ("", "", "x"), (1, 8): (" ", "", "x"), (1, 9): ("https://m.org/c.html", "", "y" * 500 + "…"),
        (1, 10): ("/x//y.html", "", "y" * 500), (1, 11): ("/pdfs/a.pdf", "", "x"), (None, 1): ("https://x.org/a", "", "x"), (1, 12): ("", "of()", "x"),
    }
    assert [(r.q, r.failed) for r in failures.collect()] == [(2, 1)]
    assert search.citations(table, ["q"], "at", sources)[1].count() == 0


def test_hashes_of_no_documents(spark):
    docs = spark.createDataFrame([(1, 1, "a")], "q int, at int, x string")
    found = {r.q: r.hash for r in search.documents_hash(docs, "q", "at", [F.col("x")], of=spark.createDataFrame([(1,), (2,)], "q int")).collect()}
    assert found[2] == "empty" and len(found[1]) == 64


def test_schemas_quarantine_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert index.require_schema(table, {"id": "bigint", "text": "string"}) is table
    for wrong in ({"id": "int"}, {"other": "string"}):
        with pytest.raises(TypeError):
            index.require_schema(table, wrong)
    good, bad = index.quarantined(table, F.when(F.col("text").isNull(), "no text"))
    assert [r.id for r in good.collect()] == [1] and [(r.id, r.reason) for r in bad.collect()] == [(2, "no text")]
    assert index.delete_url(table.withColumn("url", F.lit("u")), " ").count() == 2
    assert index.discovered_collections(spark.createDataFrame([("g-a", True), ("g-b", None), ("x", True)], "name string, valid boolean"), "g-").select("status").distinct().first()[0] == "FAILED"
    two = spark.createDataFrame([(1, 1, "ab", "c"), (2, 1, "a", "bc")], "q int, at int, x string, y string")
    assert search.documents_hash(two, "q", "at", [F.col("x"), F.col("y")]).select("hash").distinct().count() == 2
    assert spark.range(1).select(quality.latest_reset_seconds(F.lit("5s"), F.lit("x"), F.lit(None).cast("string"))).first()[0] == 5


def test_labels_links_and_identities(spark):
    cases = {
        "https://www.x.org:8080/a": ("x.org", "https://www.x.org:8080/a#A", "https://www.x.org:8080/a#A"), "HTTPS://X.org/B#c": ("x.org", "HTTPS://X.org/B#c", "https://x.org/b#c"), "/pdfs/My-Book_2.pdf": ("My Book 2", "/pdfs/My-Book_2.pdf#A", "/pdfs/my-book_2.pdf#A"), "https://x.org/%E9.pdf": ("Source",) * 1,
        "/a/b": ("b", "/a/b#A", "/a/b#A"), "/a/": ("Local Resource", "/a/#A", "/a/#A"), "//x.org/a": ("a", "#", "#"), "javascript:alert(1)": ("Source", "#", "#"), "relative/x": ("Source", "relative/x#A", "relative/x#A"), " ": ("Source", "#", "#"), "": ("Source", "#", "#"), None: ("Source", "#", "#"), "/-_.pdf": ("PDF Document",),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, u string").select("i", urls.display_source(F.col("u")).alias("a"), urls.full_url(F.col("u"), F.lit("A")).alias("b"), urls.citation_identity(F.col("u"), F.lit("A")).alias("c")).orderBy("i").collect()
    for (url, want), r in zip(cases.items(), rows):
        assert (r.a, r.b, r.c)[: len(want)] == want, url


def test_sets_by_selector(spark):
    sets = spark.createDataFrame([("Java 25", "java/25", True, False), ("Books", "books", False, False), ("Quick", "quick/java", False, True)], "name string, path string, official boolean, quick boolean")
    names = lambda *a: [r.name for r in registry.selected_sets(sets, *a).orderBy("name").collect()]
    assert names(None) == ["Books", "Java 25"] == names(" , ") == names("ALL") and names("", True) == ["Quick"]
    assert names("java/25, BOOKS") == ["Books", "Java 25"] and names("quick") == ["Quick"]
    for wrong in ("all,books", "Java/25", "nothing", "books,quick"):
        with pytest.raises(ValueError):
            registry.selected_sets(sets, wrong)
    assert index.require_unique(sets, "path") is sets
    with pytest.raises(ValueError, match="books occurs 2 times"):
        index.require_unique(sets.unionByName(sets.where("name = 'Books'")), "path")
