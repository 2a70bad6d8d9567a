"""Index maintenance, counters and folds over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.identity import chunk_hash, sha256
from docloom.operators import batching, index, quality
from docloom.queries.functions_queries import CORPUS_SQL, corpus
from docloom.streaming import windows
from docloom.tables import read


def chunks(spark, sf_dir):
    """One chunk per document."""
    return corpus(spark, sf_dir).select("doc_id", "url", "version", "collection", "source", chunk_hash(F.col("url"), F.lit(0), F.col("text")).alias("hash"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("package"))


def c1_chunk_decisions(spark, sf_dir):
    """The markers of an earlier run: two thirds of the chunks, some with another title."""
    now = chunks(spark, sf_dir)
    title = F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.concat(F.lit(" "), "title"))
    markers = now.where("doc_id % 3 <> 0").select("hash", title.alias("title"), "package")
    return index.chunk_decisions(now, markers).select("doc_id", "decision")


def c2_file_decisions(spark, sf_dir):
    fields = ["size", "mtime", "fingerprint", "extractor", "collection"]
    now = corpus(spark, sf_dir).select("doc_id", "url", F.col("n_chars").alias("size"), (F.col("doc_id") * 7).alias("mtime"), sha256(F.col("text")).alias("fingerprint"), F.when(F.col("doc_id") % 4 != 0, F.lit("v1")).alias("extractor"), "collection")
    old = now.where("doc_id % 3 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).withColumn("extractor", F.when(F.col("doc_id") % 7 != 0, F.col("extractor")))
    return index.file_decisions(now, old, fields).select("doc_id", "decision")


def _state(spark, sf_dir):
    """Files, markers and stored points of each source's languages; what differs between them is in the hashes' digits and the texts' lengths."""
    c = chunks(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    c = c.select(F.concat_ws("/", "source", "lang", (F.col("n_chars") % 7).cast("string")).alias("url"), F.col("hash").alias("point_id"), "n_chars")
    files = c.groupBy("url").agg(F.sum("n_chars").alias("size"), F.max("n_chars").alias("mtime"), F.when(F.min("n_chars") > 60, "v1").alias("extractor"), F.sort_array(F.collect_list("point_id")).alias("hashes"))
    markers = files.where(F.col("mtime") % 5 != 0).withColumn("size", F.col("size") + F.when(F.col("mtime") % 7 == 0, 1).otherwise(0)).withColumn("extractor", F.when(F.col("mtime") % 11 != 0, F.col("extractor")))
    markers = markers.withColumn("hashes", F.when(F.col("mtime") % 13 == 0, F.slice("hashes", 2, 1000000)).otherwise(F.col("hashes")))
    digit = lambda i, low, high: F.substring("point_id", i, 2).between(low, high)
    stored = c.select("url", "point_id").where(~digit(1, "00", "07")).unionByName(c.select("url", "point_id").where(digit(3, "00", "03")))
    return files, markers, stored.unionByName(c.where(digit(5, "00", "03")).select("url", F.reverse("point_id").alias("point_id"))).where(~F.col("url").like("%/de/3"))


def c2_c4_checked_decisions(spark, sf_dir):
    files, markers, stored = _state(spark, sf_dir)
    return index.checked_file_decisions(files, markers, stored, ["size", "mtime", "extractor"]).select("url", "decision")


def c4_a16_identity(spark, sf_dir):
    files, _, stored = _state(spark, sf_dir)
    return index.identity_differences(stored, files.select("url", F.explode("hashes").alias("point_id")))


def j13_batches(spark, sf_dir):
    """Documents in the order of their sources as files of chunks; some replace what is stored."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text", F.greatest(F.lit(1), F.floor(F.length("text") / 400)).alias("chunks"))
    packed = batching.pack_batches(docs, ["source", "doc_id"], "chunks", "source", F.length("text") % 23 == 0)
    return packed.select("doc_id", "chunks", "batch")


def c3_stale_keys(spark, sf_dir):
    now = chunks(spark, sf_dir)
    return index.stale_keys(now.where("doc_id % 2 = 0"), now.where("doc_id % 3 = 0"), "url", "hash").select("doc_id", "hash")


def c4_exact_identity(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("source").alias("url"), F.col("hash").alias("point_id"), "doc_id")
    return index.identity_by_url(c.where("url <> 'src1' OR doc_id % 2 = 0"), c.where("url <> 'src2' OR doc_id % 2 = 0"))


def c5_orphans(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return index.stale_keys(c.select("url").distinct(), c.where("doc_id % 7 <> 0"), "url")


def c6_audit(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("source").alias("url"), "hash", "doc_id")
    stored = c.where("doc_id % 11 <> 0").unionByName(c.where("doc_id % 13 = 0")).unionByName(c.where("doc_id % 17 = 0").withColumn("hash", F.concat(F.lit("x"), "hash")))
    return index.audit(c.where("doc_id % 19 <> 0"), stored)


def c10_hash_prefix(spark, sf_dir):
    c = chunks(spark, sf_dir)
    files = c.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.substring("hash", 1, 12)).otherwise(F.substring("hash", 5, 12)).alias("prefix"))
    return index.by_hash_prefix(files, c.where("doc_id % 3 <> 0"))


def c14_obsolete_hashes(spark, sf_dir):
    c = chunks(spark, sf_dir)
    known = c.where("doc_id % 2 = 0").select("hash").unionByName(c.where("doc_id % 3 = 0").select("hash")).distinct()
    return index.stale_keys(known, c.where("doc_id % 5 <> 0"), "hash")


def a15_a16_upsert_and_replace(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("hash").alias("point_id"), F.col("source").alias("url"), "title")
    table, rows = c.where("title < 'M'"), c.where("url IN ('src1', 'src2') AND title < 'T'").withColumn("title", F.concat(F.lit("!"), "title"))
    one = index.upsert(table, rows, "point_id").select("point_id", "url", "title", F.lit("upsert").alias("how"))
    two = index.replace_url(table, rows).select("point_id", "url", "title", F.lit("replace").alias("how"))
    return one.unionByName(two)


def a20_set_payload(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "source", "version")
    return index.set_payload(c, F.col("source") == "src3", version=F.lit("99"))


def a28_retired_pages(spark, sf_dir):
    host = F.when(F.col("page_id") % 2 == 0, "https://docs.oracle.com/en/java/javase/25/docs/api/").when(F.col("page_id") % 4 == 1, "https://x.org/docs/api/").otherwise("https://docs.oracle.com/en/java/javase/ea/docs/api/")
    page = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("java/util/class-use/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit("List.html#of")).otherwise(F.substring_index("url", "/", -1))
    return index.retired_pages(read(spark, sf_dir, "pages").withColumn("url", F.concat(host, page))).select("page_id", "url")


def a29_a30_required_counts(spark, sf_dir):
    required = spark.createDataFrame([("books",), ("docs",), ("missing",)], "collection string")
    return index.required_counts(chunks(spark, sf_dir), required, "collection")


def d3_duplicate_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(sha256(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def b4_constraint(spark, sf_dir):
    from docloom.plans.constraints import Constraint

    c = Constraint(doc_versions=["24", " 25 "], doc_sets=["src1", "src2", "src3"])
    return chunks(spark, sf_dir).where(c.condition(version="version", doc_set="source")).select("doc_id")


ROOTS = [("a", "A"), ("a/b", "AB"), ("a/b/c", "ABC"), ("x/y", "XY")]


def c7_longest_prefix(spark, sf_dir):
    roots = spark.createDataFrame(ROOTS, "root string, name string")
    paths = [F.lit("a/b/c/d.html"), F.lit("a/bc/d"), F.lit("a\\b\\x"), F.lit("x"), F.lit("x/y")]
    path = F.element_at(F.array(*paths), (F.col("doc_id") % 5 + 1).cast("int"))
    return index.longest_prefix(read(spark, sf_dir, "documents").select("doc_id", path.alias("path")), "path", roots, "root").select("doc_id", "root", "name")


def d6_backlog(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ["processed", "skipped", "failed", "pending", "in_progress"])), (F.col("event_id") % 5 + 1).cast("int"))
    return quality.backlog_counters(read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("run"), status.alias("status")), "run")


def d8_d13_rates(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 == 0).alias("hits"), F.count_if(F.col("event_id") % 3 != 0).alias("misses"))
    return e.select("user_id", F.round(quality.percent_complete(F.col("hits"), F.col("misses")), 9).alias("percent"), F.round(quality.hit_rate(F.col("hits"), F.col("misses")), 9).alias("rate"))


#: After a number of the event.
UNITS = ["", "ms", "d", " h ", "M", "S", ".5s", "x", " ms", "MS"]


def h50_h53_durations(spark, sf_dir):
    d = F.concat((F.col("event_id") * 13 % 7000).cast("string"), F.element_at(F.array(*map(F.lit, UNITS)), (F.col("event_id") % len(UNITS) + 1).cast("int")))
    e = read(spark, sf_dir, "events")
    return e.select("event_id", quality.duration_seconds(d).alias("seconds"), quality.duration_text(F.col("event_id") * 37).alias("text"), quality.backoff_seconds(F.col("event_id") % 20).alias("backoff"))


def j1_coalesced(spark, sf_dir):
    return windows.coalesced(read(spark, sf_dir, "events").withColumn("piece", F.concat("event_type", F.col("event_id").cast("string"))), "user_id", "event_id", "piece")


def j10_extended_limits(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000 * 60_000_000).alias("until"))
    return windows.extended_limits(e, "user_id", "ts", "until").select("event_id", "active_until")


def j11_fixed_window_limit(spark, sf_dir):
    return windows.fixed_window_limit(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400).select("event_id", "accepted")


def session_windows(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events").where("user_id IS NOT NULL"), "user_id", "ts", 43200).select("user_id", F.unix_micros(F.col("began").cast("timestamp")).alias("began"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "events")


C = f"WITH {CORPUS_SQL}, c AS (SELECT *, sha256(url || '#0:' || text) AS hash, left(text, 40) AS title FROM corpus)"

STATE = f"""{C}, x AS (SELECT source || '/' || c.lang || '/' || n_chars % 7 AS url, hash, n_chars FROM c),
    f AS (SELECT url, sum(n_chars) AS size, max(n_chars) AS mtime, CASE WHEN min(n_chars) > 60 THEN 'v1' END AS extractor, list(hash ORDER BY hash) AS hashes FROM x GROUP BY 1),
    m AS (SELECT url, size + CASE WHEN mtime % 7 = 0 THEN 1 ELSE 0 END AS size, mtime, CASE WHEN mtime % 11 <> 0 THEN extractor END AS extractor, CASE WHEN mtime % 13 = 0 THEN hashes[2:] ELSE hashes END AS hashes FROM f WHERE mtime % 5 <> 0),
    st AS (SELECT url, hash FROM (SELECT url, hash FROM x WHERE substr(hash, 1, 2) NOT BETWEEN '00' AND '07' UNION ALL SELECT url, hash FROM x WHERE substr(hash, 3, 2) BETWEEN '00' AND '03' UNION ALL SELECT url, reverse(hash) FROM x WHERE substr(hash, 5, 2) BETWEEN '00' AND '03') WHERE url NOT LIKE '%/de/3'),
    s AS (SELECT url, list(hash ORDER BY hash) AS hashes FROM st GROUP BY 1)"""

SQL = {
    "j13_batches": """WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, length(text) // 400) AS chunks, length(text) % 23 = 0 OR greatest(1, length(text) // 400) > 32 AS alone, row_number() OVER (ORDER BY source, doc_id) AS k FROM documents),
        f AS (SELECT doc_id, source, chunks, k, CAST(0 AS BIGINT) AS batch, CASE WHEN alone THEN 0 ELSE chunks END AS pending FROM d WHERE k = 1
        UNION ALL SELECT d.doc_id, d.source, d.chunks, d.k, f.batch + CASE WHEN NOT d.alone AND f.pending > 0 AND d.source = f.source AND f.pending + d.chunks <= 32 THEN 0 ELSE 1 END,
            CASE WHEN d.alone THEN 0 WHEN f.pending > 0 AND d.source = f.source AND f.pending + d.chunks <= 32 THEN f.pending + d.chunks ELSE d.chunks END FROM f JOIN d ON d.k = f.k + 1)
        SELECT doc_id, chunks, batch FROM f""",
    "c2_c4_checked_decisions": f"""{STATE} SELECT f.url, CASE WHEN m.url IS NULL THEN CASE WHEN s.url IS NULL THEN 'new' ELSE 'unmarked' END
        WHEN m.size <> f.size OR m.mtime <> f.mtime OR m.extractor IS DISTINCT FROM f.extractor THEN 'changed' WHEN coalesce(s.hashes, []) = list_sort(list_distinct(m.hashes)) THEN 'skip' ELSE 'differs' END AS decision
        FROM f LEFT JOIN m ON f.url = m.url LEFT JOIN s ON f.url = s.url""",
    "c4_a16_identity": f"""{STATE}, a AS (SELECT url, hash, count(*) AS n FROM st GROUP BY 1, 2), b AS (SELECT url, hash FROM x GROUP BY 1, 2),
        j AS (SELECT coalesce(a.url, b.url) AS url, n, b.hash FROM a FULL JOIN b ON a.url = b.url AND a.hash = b.hash)
        SELECT url, CAST(coalesce(sum(n), 0) AS BIGINT) AS stored, count(hash) AS expected, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (hash IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated, bool_and(n IS NOT NULL AND hash IS NOT NULL AND n = 1) AS exact FROM j GROUP BY 1""",
    "c1_chunk_decisions": f"{C}, m AS (SELECT DISTINCT hash, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE ' ' || title END AS title FROM c WHERE doc_id % 3 <> 0) SELECT doc_id, CASE WHEN m.hash IS NULL THEN 'new' WHEN trim(c.title, ' ') = trim(m.title, ' ') THEN 'skip' ELSE 'changed' END AS decision FROM c LEFT JOIN m USING (hash)",
    "c2_file_decisions": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 OR (doc_id % 7 = 0 AND doc_id % 4 <> 0) THEN 'changed' ELSE 'unchanged' END AS decision FROM documents",
    "c3_stale_keys": f"{C} SELECT doc_id, hash FROM c WHERE doc_id % 2 = 0 AND hash NOT IN (SELECT hash FROM c WHERE doc_id % 3 = 0)",
    "c4_exact_identity": f"""{C}, s AS (SELECT source, hash, count(*) AS n FROM c WHERE source <> 'src1' OR doc_id % 2 = 0 GROUP BY 1, 2), e AS (SELECT source, hash, count(*) AS n FROM c WHERE source <> 'src2' OR doc_id % 2 = 0 GROUP BY 1, 2)
        SELECT source AS url, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS stored, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS expected, bool_and(coalesce(s.n, 0) = 1 AND coalesce(e.n, 0) = 1) AS exact FROM s FULL JOIN e USING (source, hash) GROUP BY 1""",
    "c5_orphans": f"{C} SELECT DISTINCT url FROM c WHERE doc_id % 7 = 0",
    "c6_audit": f"""{C}, st AS (SELECT source, hash FROM c WHERE doc_id % 11 <> 0 UNION ALL SELECT source, hash FROM c WHERE doc_id % 13 = 0 UNION ALL SELECT source, 'x' || hash FROM c WHERE doc_id % 17 = 0),
        s AS (SELECT source, hash, count(*) AS n FROM st GROUP BY 1, 2), e AS (SELECT DISTINCT source, hash FROM c WHERE doc_id % 19 <> 0),
        j AS (SELECT coalesce(s.source, e.source) AS url, s.n, e.hash AS eh, s.hash AS sh FROM s FULL JOIN e ON s.source = e.source AND s.hash = e.hash),
        g AS (SELECT url, count(eh) AS parsed, CAST(coalesce(sum(n), 0) AS BIGINT) AS stored, count(*) FILTER (sh IS NULL) AS missing, count(*) FILTER (eh IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicates FROM j GROUP BY 1)
        SELECT *, missing = 0 AND extra = 0 AND duplicates = 0 AS ok FROM g""",
    "c10_hash_prefix": f"{C}, f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(hash, 12) ELSE substr(hash, 5, 12) END AS prefix FROM c) SELECT * FROM f WHERE EXISTS (SELECT 1 FROM c WHERE doc_id % 3 <> 0 AND starts_with(hash, prefix))",
    "c14_obsolete_hashes": f"{C} SELECT DISTINCT hash FROM c WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND hash NOT IN (SELECT hash FROM c WHERE doc_id % 5 <> 0)",
    "a15_a16_upsert_and_replace": f"""{C}, t AS (SELECT hash AS point_id, source AS url, title FROM c WHERE title < 'M'), r AS (SELECT hash AS point_id, source AS url, '!' || title AS title FROM c WHERE source IN ('src1', 'src2') AND title < 'T')
        SELECT *, 'upsert' AS how FROM (SELECT * FROM t WHERE point_id NOT IN (SELECT point_id FROM r) UNION ALL SELECT * FROM r)
        UNION ALL SELECT *, 'replace' FROM (SELECT * FROM t WHERE url NOT IN (SELECT url FROM r) AND point_id NOT IN (SELECT point_id FROM r) UNION ALL SELECT * FROM r)""",
    "a20_set_payload": f"{C} SELECT doc_id, source, CASE WHEN source = 'src3' THEN '99' ELSE version END AS version FROM c",
    "a28_retired_pages": r"""WITH x AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://docs.oracle.com/en/java/javase/25/docs/api/' WHEN page_id % 4 = 1 THEN 'https://x.org/docs/api/' ELSE 'https://docs.oracle.com/en/java/javase/ea/docs/api/' END ||
        CASE page_id % 3 WHEN 0 THEN 'java/util/class-use/' || page_id WHEN 1 THEN 'List.html#of' ELSE regexp_extract(url, '([^/]*)$', 1) END AS url FROM pages)
        SELECT page_id, url FROM x WHERE regexp_matches(url, '^https://docs\.oracle\.com/en/java/javase/[0-9]+/docs/api/(.*/)?class-use/') OR regexp_matches(url, '^https://docs\.oracle\.com/en/java/javase/[0-9]+/docs/api/[A-Z][A-Za-z0-9_$]*\.html([?#].*)?$')""",
    "a29_a30_required_counts": f"{C} SELECT r.collection, count(c.doc_id) AS points, count(c.doc_id) > 0 AS ok FROM (VALUES ('books'), ('docs'), ('missing')) r(collection) LEFT JOIN c USING (collection) GROUP BY 1",
    "d3_duplicate_hashes": "SELECT sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "b4_constraint": f"{C} SELECT doc_id FROM c WHERE version IN ('24', '25') AND source IN ('src1', 'src2', 'src3')",
    "c7_longest_prefix": f"""WITH p AS (SELECT doc_id, replace(['a/b/c/d.html', 'a/bc/d', 'a\\b\\x', 'x', 'x/y'][1 + doc_id % 5], '\\', '/') AS path FROM documents), r(root, name) AS (VALUES {', '.join(map(str, ROOTS))}),
        j AS (SELECT doc_id, root, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(root) DESC) AS n FROM p JOIN r ON path = root OR starts_with(path, root || '/')) SELECT d.doc_id, root, name FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id AND n = 1""",
    "d6_backlog": """WITH x AS (SELECT user_id % 10 AS run, event_id % 5 AS s FROM events), g AS (SELECT run, count(*) AS eligible, count(*) FILTER (s = 0) AS processed, count(*) FILTER (s = 1) AS skipped, count(*) FILTER (s = 2) AS failed, count(*) FILTER (s = 3) AS pending, count(*) FILTER (s = 4) AS in_progress FROM x GROUP BY 1)
        SELECT *, processed + skipped + failed AS inspected, true AS conserved FROM g""",
    "d8_d13_rates": """WITH g AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS h, count(*) FILTER (event_id % 3 <> 0) AS m FROM events GROUP BY 1)
        SELECT user_id, round(CASE WHEN m > 0 THEN least(100.0::DOUBLE, h * 100.0::DOUBLE / m) ELSE 0 END, 9) AS percent, round(h / (h + m), 9) AS rate FROM g""",
    "h50_h53_durations": f"""WITH x AS (SELECT event_id, event_id * 37 AS s, event_id * 13 % 7000 AS v, lower(trim({UNITS}[1 + event_id % {len(UNITS)}])) AS u FROM events), p AS (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m FROM x)
        SELECT event_id, CAST(CASE u WHEN '' THEN v WHEN 'ms' THEN greatest(1, v // 1000) WHEN 'd' THEN v * 86400 WHEN 'h' THEN v * 3600 WHEN 'm' THEN v * 60 WHEN 's' THEN v END AS BIGINT) AS seconds,
        CASE WHEN d > 0 THEN d || 'd ' || h || 'h ' || m || 'm' WHEN h > 0 THEN h || 'h ' || m || 'm' ELSE m || 'm' END AS text,
        CAST(least(86400, 60 * pow(2, greatest(event_id % 20 - 1, 0))) AS BIGINT) AS backoff FROM p""",
    "j1_coalesced": "SELECT user_id, batch, string_agg(event_type || event_id, '' ORDER BY event_id) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 24 AS batch FROM events) GROUP BY 1, 2",
    "j10_extended_limits": "WITH x AS (SELECT event_id, user_id, ts, epoch_us(ts) + event_id % 1000 * 60000000 AS until FROM events) SELECT event_id, max(until) OVER (PARTITION BY user_id ORDER BY ts, until ROWS UNBOUNDED PRECEDING) AS active_until FROM x",
    "j11_fixed_window_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        f AS (SELECT event_id, user_id, k, t AS began, 1 AS used, true AS accepted FROM e WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t >= f.began + 86400000000 THEN e.t ELSE f.began END, CASE WHEN e.t >= f.began + 86400000000 THEN 1 ELSE least(f.used + 1, 4) END, e.t >= f.began + 86400000000 OR f.used < 3 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT event_id, accepted FROM f""",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 43200 SECOND THEN 0 ELSE 1 END AS n FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS events FROM s GROUP BY user_id, k""",
}

QUERIES = {name: globals()[name] for name in SQL}
