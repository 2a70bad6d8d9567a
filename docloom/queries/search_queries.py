"""Search under constraints, citations, and the rest of index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.identity import chunk_hash
from docloom.functions import urls
from docloom.functions.text import estimated_tokens, truncated
from docloom.operators import index, quality, search
from docloom.plans.constraints import Constraint
from docloom.queries.functions_queries import CORPUS_SQL, corpus
from docloom.queries.retrieval_queries import ALL_TERMS, benchmark_terms, searched, sparse_ranking
from docloom.tables import read

PLACES = {"version": "version", "doc_set": "source"}
SCOPE = Constraint(doc_versions=["21", "24", "25"], doc_sets=["src0", "src1", "src2", "src3"])


def pick(names, by):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(by) % len(names) + 1).cast("int"))


def within_scopes(spark, sf_dir, condition, scopes, k):
    asked = benchmark_terms(spark, sf_dir)
    found, weight = searched(spark, sf_dir, corpus(spark, sf_dir), asked, "version", "source", "collection")
    return search.search_documents(found.where(condition), asked, weight, scopes, "item_id", "doc_id", k, **PLACES)


def c15_i6_version_scopes(spark, sf_dir):
    """Each requested release has its own best rows of the scope."""
    return within_scopes(spark, sf_dir, F.lit(True), search.fan_out(SCOPE, ["25", "21"]), 5)


def i7_citation_search(spark, sf_dir):
    """Sparse only, in docs and pdfs, by two scopes."""
    return within_scopes(spark, sf_dir, F.col("collection").isin("docs", "pdfs"), {"all": Constraint(), "new": Constraint(doc_versions=["25"])}, 3)


def points(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", "version", "source", pick(["List.html", "Map.html", "Set.html"], "doc_id").alias("type_page"), pick(["of(E,E)", "of()", "entry(K,V)", ""], "doc_id").alias("anchor"), pick(["java.util", "org.other"], "doc_id").alias("package"), "text", "url")


MEMBERS = ["What does List.of(E, E) return?", "java.util.Map.entry(K, V)?", "Set.of", "plain words"]


def b5_i8_exact_overload(spark, sf_dir):
    out = None
    for i, question in enumerate(MEMBERS):
        part = search.exact_overload(points(spark, sf_dir), search.citation_condition(question, Constraint(doc_versions=["21", "24"]), **PLACES), "doc_id", 7)
        part = part.select(F.lit(i).alias("question"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def _cited(spark, sf_dir):
    """Documents as rows to cite: where each lies, its anchor and whether it lacks what a citation must have are in its text's length and letters; and the sources of two thirds."""
    often = lambda x, n: (F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))) % n
    n, page = F.length("text") % 9, F.concat(often("e", 5).cast("string"), F.lit(".html"))
    url = F.when(n == 0, F.concat(F.lit("file:///w/data/docs/"), "source", F.lit("/a//"), page)).when(n == 1, F.concat(F.lit(" file:///home/x/"), page, F.lit("#q "))).when(n == 2, F.concat(F.lit("https://x.org//api/api/"), page, F.lit("#f")))
    url = url.when(n == 3, F.concat(F.lit(" /w//data/"), page)).when(n == 4, "").when(n == 5, F.concat(F.lit("/w/data/docs/books/new/"), page, F.lit(".PDF"))).when(n == 6, F.lit(None).cast("string")).otherwise(F.concat("url", F.lit("#s")))
    rows = corpus(spark, sf_dir).select("version", "source", "doc_id", url.alias("url"), F.col("lang").alias("title"), F.element_at(F.array(*map(F.lit, ["", "of()", " ", "get(E)"])), (often("a", 4) + 1).cast("int")).alias("anchor"), F.concat(F.repeat(F.lit(" "), often("o", 3)), "text", F.lit(" ")).alias("text"))
    named = read(spark, sf_dir, "documents").where("source IS NOT NULL AND length(text) % 3 = 0").select(F.col("source").alias("mirror")).distinct()
    sources = named.select("mirror", F.concat(F.lit("https://"), "mirror", F.lit(".example.org/api")).alias("base_url"))
    return rows, sources, F.length("text") % 13 == 0


def i13_registry_citations(spark, sf_dir):
    """Citations of the documents of each release and source, in the order of their ids, by the registry's URLs."""
    rows, sources, failed = _cited(spark, sf_dir)
    return search.citations(rows, ["version", "source"], "doc_id", sources, failed=failed)[0].withColumn("snippet", F.sha2("snippet", 256))


def i13_failed_conversions(spark, sf_dir):
    rows, sources, failed = _cited(spark, sf_dir)
    return search.citations(rows, ["version", "source"], "doc_id", sources, failed=failed)[1]


def _linked(spark, sf_dir):
    """Pages' URLs in the forms that citations have, by the length of the page."""
    n, host = F.length("html") % 7, F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    url = F.when(n == 0, F.concat("url", F.lit("/a-b__c%20d+e.PDF?x=1#y"))).when(n == 1, F.concat(F.lit("/local/"), F.regexp_extract("url", "([^/]*)$", 1))).when(n == 2, F.concat(F.lit("javascript:"), "url")).when(n == 3, F.concat(F.lit(" "), F.replace("url", F.lit("http"), F.lit("HTTP"))))
    url = url.when(n == 4, F.lit(None).cast("string")).when(n == 5, F.regexp_replace("url", "^[a-z]+://", "https://www."))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), url.otherwise(F.col("url")).alias("url"), F.when(F.length("html") % 3 == 0, "Of(E)").when(F.length("html") % 3 == 1, "").alias("anchor"))


def h39l_citation_labels(spark, sf_dir):
    u, a = F.col("url"), F.col("anchor")
    return _linked(spark, sf_dir).select("page_id", urls.display_source(u).alias("label"), urls.full_url(u, a).alias("link"), urls.citation_identity(u, a).alias("identity"))


def h39l_distinct_citations(spark, sf_dir):
    """The pages of each host as citations, without repeats."""
    return search.distinct_citations(_linked(spark, sf_dir).withColumn("url", F.regexp_replace("url", "/[0-9]+.*$", "/x")), ["host"], "page_id").select("host", "page_id", "url", "anchor")


def h51_reset_headers(spark, sf_dir):
    """Headers of every form made of the events' times and amounts, read at the time of the event before the last hour."""
    e, at = read(spark, sf_dir, "events"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    n = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 7
    zone = F.date_format(at + F.expr("INTERVAL 2 HOURS"), "EEE, d MMM yyyy HH:mm:ss")
    header = F.when(n == 0, F.unix_timestamp(at).cast("string")).when(n == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 2, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(n == 3, F.concat(F.lit(" "), zone, F.lit(" +0200")))
    header = header.when(n == 4, F.date_format(at, "d MMM yyyy HH:mm 'gmt'")).when(n == 5, F.concat(F.lit("in "), F.col("event_type"))).otherwise(F.lit(None).cast("string"))
    now = F.col("ts").cast("timestamp") - F.expr("INTERVAL 30 MINUTES") * F.when(F.col("event_type") == "click", -1).otherwise(1)
    return e.select("event_id", F.unix_timestamp(quality.reset_instant(header)).alias("resets"), quality.retry_after_seconds(header, now).alias("wait"))


def c11_platform_package(spark, sf_dir):
    """Members of the documents; the platform has a type in several packages if several of its sources do."""
    m = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 37).cast("string")).alias("type"), F.col("lang").alias("method"))
    platform = read(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.concat(F.lit("p."), "source").alias("package"), F.concat(F.lit("T"), (F.col("doc_id") % 61).cast("string")).alias("type"), F.col("lang").alias("method"))
    return search.platform_package(m, platform)


def d11_h5_documents_hash(spark, sf_dir):
    found = sparse_ranking(spark, sf_dir, 8).join(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return search.documents_hash(found, "item_id", "rank", [F.col("doc_id").cast("string"), F.col("text"), F.lit("source"), F.col("source")])


def b14_c13_retained(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").where("quality = 1")
    return search.retained(read(spark, sf_dir, "documents").select("doc_id", "source"), ids, "doc_id")


def b1_b3_payload(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", pick([" ", "a", "", "b"], "doc_id").alias("title"), "source", (F.col("n_chars") * 1_000_000 * (F.col("doc_id") % 3 - 1)).alias("chunk_index"), F.length("text").alias("not_returned"))
    return search.payload_rows(c, ["title", "source"], ["chunk_index"]).select("doc_id", "title", "source", "chunk_index")


def chunks(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", F.concat(F.lit("https://x/"), "source").alias("url"), chunk_hash(F.col("url"), F.lit(0), F.col("text")).alias("point_id"))


def a17_a19_points_of_urls(spark, sf_dir):
    """What the URLs still have after one URL and the points of another table are deleted."""
    c = chunks(spark, sf_dir)
    left = index.delete_points(index.delete_url(index.delete_url(c, "https://x/src1"), " "), c.where("doc_id % 4 = 0"))
    return index.points_of_urls(left, c.select("url"))


def c2b_coverage(spark, sf_dir):
    c = chunks(spark, sf_dir)
    files = c.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", F.when(F.col("n") % 2 == 0, F.col("n") - 5).when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("expected"))
    return index.sufficient_coverage(files, c.where("doc_id % 50 <> 7 AND url <> 'https://x/src2'"))


def a14_mirrors(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("source"), F.concat(F.col("page_id").cast("string"), pick([".html", ".HTM", ".pdf"], "page_id")).alias("path"))
    sources = files.select("source").distinct().withColumn("min_files", F.length("source") % 9)
    return index.accepted_mirrors(files, sources)


def a27_collections(spark, sf_dir):
    named = lambda p, bad: read(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.col("doc_id") % 100 < bad).alias("valid")).select(F.concat(F.lit(p), "source").alias("name"), "valid")
    both = named("github-a-", 100).unionByName(named("github-b-", 0)).unionByName(named("docs-", 0))
    return index.discovered_collections(both, "github-a-").unionByName(index.discovered_collections(both, "github-b-"))


def d16_latest_reset(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a, b, c = (F.concat((F.col("event_id") * m % 977).cast("string"), pick(u, "event_id")) for m, u in ((7, ["s", "ms", "", "m"]), (11, ["h", "x", "s"]), (13, ["", "d", "S", ".5s", "ms"])))
    return e.select("event_id", quality.latest_reset_seconds(F.when(F.col("event_id") % 6 != 0, a), b, F.when(F.col("event_id") % 4 == 0, c)).alias("seconds"))


def b20_spam(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rendered = F.when(F.col("event_id") % 7 != 0, at - F.col("event_id") % 6000 * F.when(F.col("event_id") % 11 == 0, -1).otherwise(1))
    return e.select("event_id", quality.is_spam(F.when(F.col("event_id") % 13 == 0, F.col("event_type")).otherwise(" "), rendered, at).alias("spam"))


def b22_chunk_outcome(spark, sf_dir):
    t = F.split("text", "\n")
    skipped = F.when(F.col("doc_id") % 3 == 0, F.size(t)).otherwise((F.col("doc_id") % 4).cast("int"))
    total = F.when(F.col("doc_id") % 10 == 9, 0).otherwise(F.size(t))
    return read(spark, sf_dir, "documents").select("doc_id", quality.chunk_outcome(t, total, skipped).alias("x")).select("doc_id", "x.*")


def d5_d9_run_totals(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("source").alias("run"), estimated_tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 3).alias("seconds"))
    return quality.run_totals(files, "run").withColumn("per_second", F.round("per_second", 9))


def d18_joined_notices(spark, sf_dir):
    return quality.joined_notices(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def j5_in_sequence(spark, sf_dir):
    """Status, notices, text and citations of each conversation, to be read in the order of seq and n."""
    turns = read(spark, sf_dir, "conversations")
    part = lambda rows, text: rows.select("conv_id", F.col("turn").alias("n"), text.alias("text"))
    status = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turn")).select("conv_id", "turn")
    return search.in_sequence(part(status, F.lit("status")), part(turns.where("role = 'system'"), F.lit("notice")), part(turns.where("role = 'assistant'"), F.sha2(F.coalesce("text", F.lit("")), 256)), part(turns.where("role = 'user'"), F.lit("citation")))


def f3_f5_document_caps(spark, sf_dir):
    """The first three of each ranking, each cut to 600 tokens."""
    found = sparse_ranking(spark, sf_dir, 3).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = found.withColumn("cut", truncated(F.col("text"), 600))
    return found.select("item_id", "rank", "doc_id", "cut.truncated", F.length("cut.text").cast("long").alias("chars"))


SIZED = "printf('%08X', octet_length(encode({x}))) || hex(encode({x}))"
DURATION = "CASE WHEN regexp_full_match({x}, '[0-9]+ms') THEN greatest(1, CAST(rtrim({x}, 'ms') AS BIGINT) // 1000) WHEN regexp_full_match({x}, '[0-9]+[dhms]?') THEN CAST(regexp_extract({x}, '^[0-9]+') AS BIGINT) * CASE right({x}, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END ELSE 0 END"
JOINED = f"WITH {ALL_TERMS}, {CORPUS_SQL}, j AS (SELECT s.*, c.version, c.source, c.collection FROM scores s JOIN corpus c USING (doc_id))"

CITED = f"""{CORPUS_SQL}, mirrors AS (SELECT DISTINCT source FROM documents WHERE length(text) % 3 = 0),
    x0 AS (SELECT c.*, m.source IS NOT NULL AS mirrored, length(text) % 9 AS n, (length(text) - length(replace(text, 'e', ''))) % 5 || '.html' AS page, ['', 'of()', ' ', 'get(E)'][1 + (length(text) - length(replace(text, 'a', ''))) % 4] AS anchor, repeat(' ', CAST((length(text) - length(replace(text, 'o', ''))) % 3 AS BIGINT)) || text || ' ' AS said FROM corpus c LEFT JOIN mirrors m ON c.source = m.source),
    x1 AS (SELECT *, CASE n WHEN 0 THEN CASE WHEN mirrored THEN 'https://' || source || '.example.org/api/a/' || page ELSE '(local file path redacted)' END WHEN 1 THEN '(local file path redacted)' WHEN 2 THEN 'https://x.org/api/' || page || '#f' WHEN 3 THEN '/w//data/' || page WHEN 4 THEN '' WHEN 5 THEN '/pdfs/' || page || '.PDF' WHEN 6 THEN '' ELSE url || '#s' END AS normal FROM x0),
    x2 AS (SELECT *, CASE WHEN trim(anchor) <> '' THEN split_part(normal, '#', 1) || '#' || anchor ELSE normal END AS refined FROM x1),
    cited AS (SELECT version, source, doc_id, lang AS title, said AS text, refined, CASE WHEN n = 1 THEN 'file:///home/x/' || page WHEN n = 0 AND NOT mirrored THEN 'file:///w/data/docs/' || source || '/a//' || page ELSE refined END AS identity, length(said) % 13 = 0 AS failed FROM x2)"""

LINKED = r"""l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url AS raw, length(html) % 7 AS n, CASE length(html) % 3 WHEN 0 THEN 'Of(E)' WHEN 1 THEN '' END AS anchor,
    CASE length(html) % 7 WHEN 0 THEN url || '/a-b__c%20d+e.PDF?x=1#y' WHEN 1 THEN '/local/' || regexp_extract(url, '([^/]*)$', 1) WHEN 2 THEN 'javascript:' || url WHEN 3 THEN ' ' || replace(url, 'http', 'HTTP') WHEN 4 THEN NULL WHEN 5 THEN regexp_replace(url, '^[a-z]+://', 'https://www.') ELSE url END AS url FROM pages)"""
FULL = "CASE WHEN n IN (2, 4) OR {u} IS NULL THEN '#' WHEN coalesce(anchor, '') <> '' AND NOT contains({u}, '#') THEN trim({u}) || '#' || anchor ELSE trim({u}) END"

SQL = {
    "h39l_citation_labels": f"""WITH {LINKED}, f AS (SELECT *, {FULL.format(u='url')} AS link FROM l)
        SELECT page_id, CASE n WHEN 0 THEN CASE WHEN contains(raw, '?') OR contains(raw, '#') THEN regexp_replace(host, '^www[.]', '') ELSE 'a b c d+e' END WHEN 1 THEN coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), 'Local Resource') WHEN 2 THEN 'Source' WHEN 3 THEN 'Source' WHEN 4 THEN 'Source' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www[.]', '') END AS label,
        link, lower(regexp_extract(link, '^([^#]*)', 1)) || regexp_extract(link, '(#.*)$', 1) AS identity FROM f""",
    "h39l_distinct_citations": f"""WITH {LINKED}, g AS (SELECT * REPLACE (regexp_replace(url, '/[0-9]+.*$', '/x') AS url) FROM l), f AS (SELECT *, {FULL.format(u='url')} AS link FROM g WHERE url IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY host, lower(regexp_extract(link, '^([^#]*)', 1)) || regexp_extract(link, '(#.*)$', 1) ORDER BY page_id) AS r FROM f) SELECT host, page_id, url, anchor FROM k WHERE r = 1""",
    "c15_i6_version_scopes": f"{JOINED}, r AS (SELECT item_id, version AS scope, doc_id, score, row_number() OVER (PARTITION BY item_id, version ORDER BY score DESC, doc_id) AS rank FROM j WHERE version IN ('25', '21') AND source IN ('src0', 'src1', 'src2', 'src3')) SELECT * FROM r WHERE rank <= 5",
    "i7_citation_search": f"""{JOINED}, o AS (SELECT item_id, 'all' AS scope, doc_id, score FROM j WHERE collection IN ('docs', 'pdfs') UNION ALL SELECT item_id, 'new', doc_id, score FROM j WHERE collection IN ('docs', 'pdfs') AND version = '25'),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, scope ORDER BY score DESC, doc_id) AS rank FROM o) SELECT * FROM r WHERE rank <= 3""",
    "b5_i8_exact_overload": """WITH p AS (SELECT doc_id, ['21', '24', '25'][1 + doc_id % 3] AS version, ['List.html', 'Map.html', 'Set.html'][1 + doc_id % 3] AS page, ['of(E,E)', 'of()', 'entry(K,V)', ''][1 + doc_id % 4] AS anchor, ['java.util', 'org.other'][1 + doc_id % 2] AS package FROM documents),
        q AS (SELECT 0 AS question, doc_id FROM p WHERE page = 'List.html' AND anchor = 'of(E,E)' AND version IN ('21', '24') UNION ALL SELECT 1, doc_id FROM p WHERE page = 'Map.html' AND anchor = 'entry(K,V)' AND package = 'java.util' AND version IN ('21', '24')
          UNION ALL SELECT 2, doc_id FROM p WHERE page = 'Set.html' AND version IN ('21', '24') UNION ALL SELECT 3, doc_id FROM p WHERE version IN ('21', '24'))
        SELECT question, doc_id, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS n FROM q) WHERE n <= 7""",
    "i13_registry_citations": f"""WITH {CITED}, n AS (SELECT *, row_number() OVER (PARTITION BY version, source, identity, CASE WHEN trim(identity) = '' THEN doc_id END ORDER BY doc_id) AS n FROM cited WHERE NOT failed)
        SELECT version, source, doc_id, split_part(refined, '#', 1) AS url, title, CASE WHEN contains(refined, '#') THEN substr(refined, strpos(refined, '#') + 1) ELSE '' END AS anchor, sha256(CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END) AS snippet FROM n WHERE n = 1""",
    "i13_failed_conversions": f"WITH {CITED} SELECT version, source, count(*) AS failed FROM cited WHERE failed GROUP BY 1, 2",
    "h51_reset_headers": """WITH x AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 % 7 AS n, CASE WHEN event_type = 'click' THEN 1800000000 ELSE -1800000000 END AS late FROM events),
        y AS (SELECT *, CASE WHEN n IN (2, 3) THEN s WHEN n = 4 THEN s // 60 * 60 END AS date FROM x)
        SELECT event_id, CASE WHEN n IN (0, 1) THEN s END AS resets, CASE WHEN n = 0 THEN s WHEN n IN (2, 3, 4) THEN greatest(0, CAST(floor((date * 1000000 - (us + late)) / 1000000.0) AS BIGINT)) WHEN n = 6 THEN 0 END AS wait FROM y""",
    "c11_platform_package": """WITH p AS (SELECT 'T' || doc_id % 61 AS type, lang AS method, min('p.' || source) AS package FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1, 2 HAVING count(DISTINCT source) = 1)
        SELECT doc_id, m.type, m.method, package FROM (SELECT doc_id, 'T' || doc_id % 37 AS type, lang AS method FROM documents) m LEFT JOIN p ON m.type = p.type AND m.method = p.method""",
    "d11_h5_documents_hash": f"""WITH {ALL_TERMS}, r AS (SELECT item_id, rank, {' || '.join(SIZED.format(x=x) for x in ('doc_id::VARCHAR', 'text', "'source'", 'source'))} AS h FROM ranked JOIN documents USING (doc_id) WHERE rank <= 8)
        SELECT item_id, sha256(unhex(string_agg(h, '' ORDER BY rank))) AS hash FROM r GROUP BY 1""",
    "b14_c13_retained": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "b1_b3_payload": "SELECT doc_id, nullif(trim([' ', 'a', '', 'b'][1 + doc_id % 4]), '') AS title, source, CAST(greatest(-2147483648, least(2147483647, n_chars * 1000000 * (doc_id % 3 - 1))) AS INT) AS chunk_index FROM documents",
    "a17_a19_points_of_urls": f"""WITH {CORPUS_SQL}, c AS (SELECT doc_id, 'https://x/' || source AS url, sha256(url || '#0:' || text) AS point_id FROM corpus), l AS (SELECT * FROM c WHERE url <> 'https://x/src1' AND point_id NOT IN (SELECT point_id FROM c WHERE doc_id % 4 = 0))
        SELECT u.url, count(point_id) AS points, min(point_id) AS first_point FROM (SELECT DISTINCT url FROM c) u LEFT JOIN l USING (url) GROUP BY 1""",
    "c2b_coverage": """WITH c AS (SELECT doc_id, 'https://x/' || source AS url FROM documents), f AS (SELECT url, CASE WHEN count(*) % 2 = 0 THEN count(*) - 5 WHEN count(*) % 3 = 0 THEN 0 ELSE count(*) END AS expected FROM c GROUP BY 1),
        s AS (SELECT url, count(*) AS n FROM c WHERE doc_id % 50 <> 7 AND url <> 'https://x/src2' GROUP BY 1) SELECT url, expected, coalesce(n, 0) > 0 AND (expected <= 0 OR n >= expected) AS covered FROM f LEFT JOIN s USING (url)""",
    "a14_mirrors": """WITH f AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source, page_id % 3 < 2 AS page FROM pages) SELECT source, CAST(length(source) % 9 AS INT) AS min_files, count(*) FILTER (page) AS files, count(*) FILTER (page) >= length(source) % 9 AS accepted FROM f GROUP BY source""",
    "a27_collections": "SELECT 'github-a-' || source AS name, 'READY' AS status FROM documents GROUP BY source UNION ALL SELECT 'github-b-' || source, 'FAILED' FROM documents GROUP BY source",
    "d16_latest_reset": f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_id * 7 % 977 || ['s', 'ms', '', 'm'][1 + event_id % 4] ELSE '' END AS a, event_id * 11 % 977 || ['h', 'x', 's'][1 + event_id % 3] AS b, CASE WHEN event_id % 4 = 0 THEN lower(event_id * 13 % 977 || ['', 'd', 'S', '.5s', 'ms'][1 + event_id % 5]) ELSE '' END AS c FROM events)
        SELECT event_id, nullif(greatest({', '.join(DURATION.format(x=c) for c in 'abc')}), 0) AS seconds FROM x""",
    "b20_spam": "WITH x AS (SELECT event_id, event_id % 13 = 0 AS h, epoch_ms(ts) AS t, CASE WHEN event_id % 7 <> 0 THEN epoch_ms(ts) - event_id % 6000 * CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 END END AS r FROM events) SELECT event_id, h OR r IS NULL OR r <= 0 OR t - r < 3000 AS spam FROM x",
    "b22_chunk_outcome": """WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), y AS (SELECT doc_id, n, CASE WHEN doc_id % 10 = 9 THEN 0 ELSE n END AS t, CASE WHEN doc_id % 3 = 0 THEN n ELSE doc_id % 4 END AS s FROM x)
        SELECT doc_id, t = 0 AS generated_none, t > 0 AND s = t AS skipped_all, s <= t AND n = t AS valid FROM y""",
    "d5_d9_run_totals": """WITH x AS (SELECT source AS run, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + 1 END AS tokens, doc_id % 3 AS seconds FROM documents), g AS (SELECT run, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(seconds) AS BIGINT) AS seconds FROM x GROUP BY 1)
        SELECT *, round(CASE WHEN seconds > 0 THEN files / seconds ELSE 0 END, 9) AS per_second FROM g""",
    "d18_joined_notices": "SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS notice FROM conversations GROUP BY 1",
    "j5_in_sequence": """SELECT conv_id, count(*) AS n, 'status' AS text, 0 AS seq FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, turn, 'notice', 1 FROM conversations WHERE role = 'system'
        UNION ALL SELECT conv_id, turn, sha256(coalesce(text, '')), 2 FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'citation', 3 FROM conversations WHERE role = 'user'""",
    "f3_f5_document_caps": f"""WITH {ALL_TERMS}, x AS (SELECT item_id, rank, doc_id, text, left(text, 2400) AS h FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3),
        y AS (SELECT *, 2400 - least(CASE WHEN contains(h, '.') THEN strpos(reverse(h), '.') ELSE 2401 END, CASE WHEN contains(h, chr(10)) THEN strpos(reverse(h), chr(10)) ELSE 2401 END) AS p FROM x)
        SELECT item_id, rank, doc_id, length(text) > 2400 AS truncated, CASE WHEN length(text) <= 2400 THEN length(text) WHEN p > 1920 THEN p + 1 + 43 ELSE 2400 + 43 END AS chars FROM y""",
}

QUERIES = {name: globals()[name] for name in SQL}
