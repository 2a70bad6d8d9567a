"""The registry's rules on hand-made rows."""

from pyspark.sql import functions as F

from docloom.operators import registry
from docloom.queries.registry_queries import COLUMNS, SOURCES
from docloom.streaming import windows


def test_places_without_a_public_url_and_columns_that_clash(spark):
    rows = [(1, None), (2, ""), (3, "file://"), (4, "file:///w/data/docs/guides"), (5, "file:///w/data/docs/guides/"), (6, "file:///data/docs/guides/x\\data\\docs\\guides\\a\\b.html"), (7, "file:///w/data/docs/books/x.pdf")]
    table = spark.createDataFrame(rows, "id int, url string").withColumns({"source": F.lit("s"), "mirror": F.lit("m"), "api": F.lit("a")})
    out = registry.document_urls(table, "url", spark.createDataFrame(SOURCES, COLUMNS))
    assert sorted(out.columns) == ["api", "id", "mirror", "public_url", "source", "url"]
    assert {r.id: r.public_url for r in out.collect()} == {1: None, 2: "", 3: registry.REDACTED, 4: registry.REDACTED, 5: "https://guides.example.org/", 6: "https://guides.example.org/x/data/docs/guides/a/b.html", 7: "/pdfs/x.pdf"}
    assert registry.document_urls(table.limit(0), "url", spark.createDataFrame([], COLUMNS)).count() == 0


def test_provenance_of_null_and_foreign_files(spark):
    rows = [(1, "/data/docs/guides", "/elsewhere/x.html", None), (2, "/w/x", None, "https://blog.jetbrains.com/2"), (3, None, "/a", None), (4, "/data/docs/java/java25-api", "/data/docs/java/java25-api/notes/n.html", "u"), (4, "/data/docs/java/java25-api", "/data/docs/java/java25-api/notes/n.html", "u")]
    found = registry.provenance(spark.createDataFrame(rows, "id int, root string, path string, url string"), "root", "path", "url", spark.createDataFrame(SOURCES, COLUMNS)).collect()
    assert len(found) == 5
    by_id = {r.id: (r.doc_set, r.doc_path, r.source_name, r.source_kind, r.doc_version, r.doc_type) for r in found}
    assert by_id[1] == ("guides", "", "guides", "official", "", "guide")
    assert by_id[2][:5] == ("x", "", "x", "unknown", "2")
    assert by_id[4] == ("java/java25-api", "notes/n.html", "oracle", "official", "25", "api-docs")


def test_a_limit_is_extended_and_replaced(spark):
    rows = [(1, 1, 0, True, 100), (1, 2, 10, True, 50), (1, 3, 20, False, None), (1, 4, 99, True, 120), (1, 5, 130, True, None), (1, 6, 135, True, 131), (1, 7, 140, False, None), (2, 8, 0, False, 5)]
    out = windows.provider_windows(spark.createDataFrame(rows, "k int, id int, t long, failed boolean, until long"), "k", "t", "id", "failed", "until", 10)
    assert {r.id: (r.available, r.active_until, r.failures) for r in out.collect()} == {
        1: (False, 100, 1), 2: (False, 100, 2), 3: (False, 100, 0), 4: (False, 120, 1), 5: (False, 140, 2), 6: (False, 140, 3), 7: (True, None, 0), 8: (True, None, 0),
    }


def test_undelivered_events_give_their_place_back():
    w = windows.FixedWindow(2, 10)
    assert [w.accept(t, d) for t, d in [(0, False), (1, True), (2, False), (3, True), (4, True), (10, True)]] == [True, True, True, True, False, True]


def test_files_of_one_source_are_no_hot_key(spark):
    """Most rows have no folder, or the same: they meet the few sources that are found without a shuffle."""
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("file:///w/data/docs/m/"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.lit("https://x.org/"), F.col("id").cast("string")))
    sources = spark.createDataFrame([("m", "https://m.org/")], "mirror string, base_url string")
    found = registry.document_urls(spark.range(3_000_000).withColumn("url", url), "url", sources)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.where("id < 3").orderBy("id").select("public_url").collect() == [("https://m.org/0",), ("https://x.org/1",), (None,)]
