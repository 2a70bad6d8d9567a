import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, fusion, prompt, quality
from docloom.sources import files
from docloom.streaming import jobs, windows


def test_windows_cover_all_tokens(spark):
    rows = spark.createDataFrame([(i, " ".join(f"t{k}" for k in range(i))) for i in range(25)] + [(99, None)], "id int, text string")
    found = chunking.token_windows(rows, chunking.white_space_tokens(F.col("text")), 7, 3).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r.chunk_index, r.chunk))
    for i in range(25):
        want, at = [], 0
        while i and (not want or at - 4 + 7 < i):
            want.append([f"t{k}" for k in range(at, min(i, at + 7))])
            at += 4
        assert [c for _, c in sorted(by.get(i, []))] == want
    assert 99 not in by
    with pytest.raises(ValueError):
        chunking.token_windows(rows, F.lit(None), 5, 5)


def test_version_coverage():
    rows = [{"id": i, "version": v} for i, v in enumerate(["21", "21", "x", "24", "25"])]
    ids = lambda requested, limit: [r["id"] for r in fusion.version_coverage(rows, requested, limit)]
    assert ids(["21", "24"], 3) == [0, 1, 3] and ids([], 2) == [0, 1]
    assert ids(["21", "24", "25"], 3) == [0, 3, 4] or ids(["21", "24", "25"], 3) == [0, 4, 3]
    with pytest.raises(ValueError):
        ids(["21", "24", "25"], 2)
    with pytest.raises(LookupError):
        ids(["17"], 2)


def fit(spark, docs, turns, limit, system=100, query=50):
    schema = "id int, system_tokens int, query_tokens int, docs array<struct<index:int,url:string,text:string,tokens:int,priority:string>>, turns array<struct<index:int,role:string,text:string,tokens:int>>"
    rows = [(1, system, query, [(i, f"u{i}", f"d{i}", t, p) for i, (p, t) in enumerate(docs)], [(i, "user", f"t{i}", t) for i, t in enumerate(turns)])]
    r = prompt.fitted_prompt(spark.createDataFrame(rows, schema), limit).first()
    return [d.url for d in r.docs], [t["index"] for t in r.turns], [d["index"] for d in r.docs], r.minimal, r.error


def test_prompts_that_fit(spark):
    assert fit(spark, [("HIGH", 200)] * 3, [50], 400)[:2] == (["u0"], [0])
    assert fit(spark, [], [100, 100, 100], 300)[1] == [2]
    assert fit(spark, [("HIGH", 150), ("LOW", 100)], [150], 350)[:2] == (["u0"], [])
    assert fit(spark, [("LOW", 100), ("HIGH", 80), ("LOW", 100), ("HIGH", 70)], [50], 350)[:3] == (["u1", "u3"], [0], [1, 2])
    assert fit(spark, [("LOW", 1)], [1], 150)[3] and fit(spark, [("HIGH", 1)], [1], 150)[3:] == (True, False)
    assert fit(spark, [("HIGH", 900)], [10], 400)[4] and fit(spark, [("HIGH", 1)], [1], 120)[:4] == ([], [], [], True)


def test_quality_levels(spark):
    rows = [("a", "x" * 150, "https://x"), ("a", "x" * 150, "https://y"), ("b", "x" * 150, "https://x"), ("b", "short", "u"), ("c", "x", "local-search://q"), ("d", None, None), ("e", "x" * 150, "https://x/keyword/y")]
    found = {r.q: r.level for r in quality.search_quality(spark.createDataFrame(rows, "q string, text string, url string"), "q").collect()}
    assert found == {"a": "HIGH_QUALITY", "b": "MIXED_QUALITY", "c": "KEYWORD_SEARCH", "d": "NONE", "e": "KEYWORD_SEARCH"}


def test_fixed_window():
    w = windows.FixedWindow(3, 3600)
    assert [w.accept(t) for t in (0, 10, 20, 30, 3599, 3600, 3601)] == [True, True, True, False, False, True, True]


def test_reset_headers(spark):
    headers = ["15", "1700000000", "60s", "abc", "2030-01-02T03:04:05Z", "2030-01-02T03:04:05.5+02:00", " ", None, "Tue, 3 Jun 2008 11:05:30 GMT", "3 jun 2008 11:05 +0130", "Mon, 3 Jun 2008 11:05:30 GMT", "31 Feb 2008 11:05 GMT", "99999999999999999999"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, x string").withColumn("now", F.timestamp_seconds(F.lit(1212490000)))
    got = rows.select("i", F.unix_timestamp(quality.reset_instant(F.col("x"))).alias("reset"), quality.retry_after_seconds(F.col("x"), F.col("now")).alias("wait")).orderBy("i").collect()
    assert [r.reset for r in got] == [15, 1700000000, None, None, 1893553445, 1893546245, None, None, None, None, None, None, None]
    assert [r.wait for r in got] == [15, 1700000000, None, None, None, None, 0, 0, 1130, 0, None, None, None]
    for value in (quality.reset_instant(F.lit("abc"), strict=True), quality.retry_after_seconds(F.lit("60s"), F.current_timestamp(), strict=True)):
        with pytest.raises(Exception, match="Invalid"):
            spark.range(1).select(value).collect()
    assert spark.range(1).select(quality.retry_after_seconds(F.lit(None).cast("string"), F.current_timestamp(), strict=True)).first()[0] == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "A.java").write_text("package a.b;\x07")
    (tmp_path / "src" / "blank.py").write_text("  \n")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "src" / "x.bin").write_text("x")
    (tmp_path / "src" / "node_modules" / "y.js").write_text("y")
    (tmp_path / "Page.HTML").write_text("<p>x</p>")
    root = f"file:{tmp_path}"
    assert [(r.language, r.text) for r in files.source_files(spark, root).where("language = 'java'").collect()] == [("java", "package a.b;")]
    assert {r.path.rsplit("/", 1)[-1] for r in files.source_files(spark, root).collect()} == {"A.java", "Page.HTML"}
    documents = files.document_files(spark, root)
    assert documents.count() == 1 and files.require_inventory(documents) is documents
    assert files.inventory_fingerprint(documents, str(tmp_path)) == files.inventory_fingerprint(documents, str(tmp_path))


def test_api_seeds_and_lessons(spark, tmp_path):
    types = spark.createDataFrame([("java.util", "List"), ("no.where", "X")], "package string, type string")
    modules = spark.createDataFrame([("java.util", "java.base")], "package string, module string")
    found = [r.url for r in files.api_seed_urls(types, modules, "https://x/api/").collect()]
    assert "https://x/api/java.base/java/util/List.html" in found and len(found) == 4 + 1 + 3 + 1
    (tmp_path / "toc.json").write_text('[{"slug": "a-b", "title": "T", "sourceReferences": ["docs"], "more": 1}, {"slug": "Bad-"}]')
    official = spark.createDataFrame([("docs",)], "doc_set string")
    assert [r.slug for r in files.read_lessons(spark, str(tmp_path / "toc.json"), official).collect()] == ["a-b"]
    with pytest.raises(ValueError):
        files.read_lessons(spark, str(tmp_path / "toc.json"), official.limit(0))


def test_ingestion_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for n in (1, 2):
        spark.range(n * 10).write.mode("append").parquet(source)
        q = jobs.ingest(spark, source, "id long", target, checkpoint, lambda df: df.withColumn("twice", F.col("id") * 2))
        q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 30
