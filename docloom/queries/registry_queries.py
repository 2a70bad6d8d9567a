"""The registry of sources, provenance, and limits of providers and senders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.identity import sha256
from docloom.operators import registry
from docloom.streaming import windows
from docloom.tables import read

COLUMNS = "mirror string, base_url string, doc_set string, source_kind string, doc_version string, doc_type string, api boolean"
SOURCES = [
    ("java/java25-api", "https://docs.oracle.com/en/java/javase/25/docs/api/", "java/java25-api", "official", "25", "api-docs", True),
    ("java/java25-api/notes", "https://notes.example.org/", "notes", "vendor", "25", "article", False),
    ("guides", "https://guides.example.org/", "guides", "official", "", "guide", False),
    ("guides/spring-framework", "https://framework.example.org/api", "spring", "official", "6", "reference", False),
    ("vendor/blog", "https://blog.example.org//", "vendor/blog", "vendor", "2", "article", False),
]
#: Roots that are read, files below them, and places of documents; `{}` is a document's number.
ROOTS = ["/w/data/docs/java/java25-api", "/w/data/docs/java", "/w/data/docs/guides/spring-framework/more", "/w/data/docs/guides", "/w/data/books", "/w/vendor/blog/", "/w/ibm", "/w/oracle9x"]
FILES = ["notes/{}.html", "java.base/{}.html", "spring-framework/{}.html", "{}.pdf"]
PLACES = [
    "file:///w/data/docs/guides/{}.html", "file:///w/data/docs/guides/spring-framework/docs/current/javadoc-api/java/{}.html", "file:///w/data/docs/guides/spring-framework/api/current/javadoc-api/java/{}.html",
    "file:///w/data/docs/java/java25-api/docs/api/java.base/{}.html", "/w/data/docs/books/new/{}.PDF", "file:///w/data/docs/guides/docs.oracle.com/en/{}//x.html", "file:///w/{}.html", "relative/{}.html", "https://a.example.org/api/api//{}.html", " ",
    "file:///w/data/docs/vendor/blog//{}.html", "file:///w/data/docs/vendor/blog", "file:///w/data/docs/guides/spring-framework/api/{}.html",
]


def sources(spark):
    return spark.createDataFrame(SOURCES, COLUMNS)


def picked(names, by):
    one = F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    return F.replace(one, F.lit("{}"), F.col("doc_id").cast("string"))


def g5_official_identities(spark, sf_dir):
    """Sources of the documents as mirrors; every third by size is an API, and half of the others are official."""
    s = read(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("mirror")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    kind = F.when(F.col("last") % 2 == 0, "official").otherwise("vendor")
    return registry.official_identities(s.select("mirror", F.concat(F.lit("set-"), "mirror").alias("doc_set"), kind.alias("source_kind"), (F.col("n") % 3 == 0).alias("api")))


def h34_h37_document_urls(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", picked(PLACES, F.col("doc_id")).alias("url"))
    return registry.document_urls(d, "url", sources(spark)).select("doc_id", "public_url")


def h38_provenance(spark, sf_dir):
    i = F.col("doc_id")
    root = picked(ROOTS, i)
    slash = F.when(root.endswith("/"), "").otherwise("/")
    below = F.concat(F.when(i % 11 == 0, F.lit("/other")).otherwise(root), slash, picked(FILES, F.floor(i / 8)))
    url = F.concat(F.element_at(F.array(*map(F.lit, ["https://www.ibm.com/", "https://x/pdfs/", "https://docs.oracle.com/en/java/javase/21/"])), (i % 3 + 1).cast("int")), F.col("source"))
    d = read(spark, sf_dir, "documents").select("doc_id", root.alias("root"), below.alias("path"), url.alias("url"))
    return registry.provenance(d, "root", "path", "url", sources(spark)).drop("root", "path", "url")


def h44_pdf_title(spark, sf_dir):
    """Metadata made of the texts; a third has a title."""
    metadata = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Pages: 3\r\nTITLE: "), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.lit("title:  \nx"))
    name = F.element_at(F.array(F.lit("a.b.pdf"), F.lit(".pdf"), F.lit("plain")), (F.floor(F.col("doc_id") / 3) % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", sha256(registry.pdf_title(metadata, name)).alias("title"))


def j10_provider_windows(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    until = F.when(F.col("event_id") % 5 != 0, at + (F.col("event_id") % 1000 - 100) * 60_000_000)
    e = read(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"), (F.col("event_type") == "error").alias("failed"), until.alias("until"))
    return windows.provider_windows(e, "user_id", "at", "event_id", "failed", "until", 600_000_000).select("event_id", "available", "active_until", "failures")


def j11_returned_slots(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 3 != 0).alias("sent"))
    return windows.fixed_window_limit(e, "user_id", "ts", "event_id", 3, 172800, "sent").select("event_id", "accepted")


def listed(names):
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


S = f"WITH RECURSIVE s(mirror, base_url, doc_set, source_kind, doc_version, doc_type, api) AS (VALUES {', '.join(str(x).replace('True', 'true').replace('False', 'false') for x in SOURCES)})"
PICK = lambda names, by="doc_id": f"replace({listed(names)}[1 + {by} % {len(names)}], '{{}}', doc_id::VARCHAR)"
CANONICAL = "regexp_extract({x}, '^([a-z]+://)?', 0) || regexp_replace(regexp_replace(replace(replace({x}, '/docs/api/api/', '/docs/api/'), '/api/api/', '/api/'), '^[a-z]+://', ''), '/+', '/', 'g')"

SQL = {
    "g5_official_identities": "SELECT CASE WHEN count(*) % 3 = 0 THEN source ELSE 'set-' || source END AS identity FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) % 3 = 0 OR max(doc_id) % 2 = 0",
    "h34_h37_document_urls": f"""{S}, d AS (SELECT doc_id, trim({PICK(PLACES)}) AS u, {PICK(PLACES)} AS raw FROM documents),
        m AS (SELECT doc_id, s.*, substr(u, strpos(u, '/data/docs/' || mirror || '/') + length('/data/docs/' || mirror || '/')) AS rel FROM d JOIN s ON starts_with(u, 'file://') AND contains(u, '/data/docs/' || mirror || '/')),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(mirror) DESC) AS n FROM m) WHERE n = 1),
        a AS (SELECT *, CASE WHEN contains(mirror, 'spring-framework') THEN regexp_replace(regexp_replace(regexp_replace(rel, '^(docs/current/)?api/current/javadoc-api/', 'docs/current/javadoc-api/'), '^docs/current/javadoc-api/java/', 'docs/current/javadoc-api/'), '^javadoc-api/java/', 'javadoc-api/') ELSE rel END AS r FROM l),
        b AS (SELECT doc_id, rtrim(base_url, '/') AS base, ltrim(r, '/') AS r FROM a),
        j AS (SELECT doc_id, base || '/' || CASE WHEN base LIKE '%/docs/api' THEN regexp_replace(r, '^(docs/)?api/', '') WHEN base LIKE '%/api' THEN regexp_replace(r, '^api/', '') ELSE r END AS url FROM b)
        SELECT doc_id, CASE WHEN u = '' THEN raw WHEN u LIKE 'http%' THEN {CANONICAL.format(x='u')} WHEN u ILIKE '%.pdf' AND contains(u, '/data/docs/books/') THEN '/pdfs/' || regexp_extract(u, '[^/]*$') WHEN u NOT LIKE 'file://%' THEN u
          WHEN contains(u, 'docs.oracle.com/') THEN 'https://' || regexp_replace(substr(u, strpos(u, 'docs.oracle.com/')), '/+', '/', 'g') WHEN url IS NOT NULL THEN {CANONICAL.format(x='url')} ELSE '(local file path redacted)' END AS public_url FROM d LEFT JOIN j USING (doc_id)""",
    "h38_provenance": f"""{S}, d AS (SELECT doc_id, rtrim({PICK(ROOTS)}, '/') AS root, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {PICK(FILES, '(doc_id // 8)')} END AS path, ['https://www.ibm.com/', 'https://x/pdfs/', 'https://docs.oracle.com/en/java/javase/21/'][1 + doc_id % 3] || source AS url FROM documents),
        k AS (SELECT d.*, (SELECT max_by(mirror, length(mirror)) FROM s WHERE contains(d.root || '/', '/' || mirror || '/')) AS mirror FROM d),
        w AS (SELECT *, CASE WHEN mirror IS NULL THEN path ELSE rtrim(substr(root || '/', strpos(root || '/', '/' || mirror || '/') + 1) || path, '/') END AS whole, coalesce(mirror, regexp_extract(root, '[^/]*$')) AS own FROM k),
        f AS (SELECT w.*, (SELECT max_by(s, length(mirror) + CASE WHEN api THEN 1000 ELSE 0 END) FROM s WHERE starts_with(w.whole || '/', s.mirror || '/')) AS f FROM w),
        n AS (SELECT *, CASE WHEN own = '' THEN 'ibm' ELSE own END AS name FROM f)
        SELECT doc_id, CASE WHEN f IS NULL THEN own WHEN f.api THEN f.mirror ELSE f.doc_set END AS doc_set, CASE WHEN f IS NULL THEN path ELSE substr(whole, length(f.mirror) + 2) END AS doc_path,
          CASE WHEN f IS NULL THEN name WHEN f.api THEN 'oracle' ELSE f.doc_set END AS source_name, CASE WHEN f IS NULL THEN CASE name WHEN 'ibm' THEN 'vendor' ELSE 'unknown' END WHEN f.api THEN 'official' ELSE f.source_kind END AS source_kind,
          CASE WHEN f IS NULL THEN coalesce(nullif(regexp_extract(own, '[0-9]+'), ''), regexp_extract(url, '[0-9]+')) ELSE f.doc_version END AS doc_version,
          CASE WHEN f IS NULL THEN CASE WHEN own LIKE 'books%' THEN 'book' WHEN url LIKE '%docs.oracle.com/en/java/javase/%' THEN 'api-docs' WHEN url LIKE '%/pdfs/%' THEN 'pdf' ELSE '' END ELSE f.doc_type END AS doc_type FROM n""",
    "h44_pdf_title": """WITH x AS (SELECT doc_id, text, ['a.b', '.pdf', 'plain'][1 + doc_id // 3 % 3] AS stem, trim(split_part(replace(text, chr(13) || chr(10), chr(10)), chr(10), 1), ' ') AS line FROM documents)
        SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 AND line <> '' THEN line ELSE stem END) AS title FROM x""",
    "j10_provider_windows": """WITH RECURSIVE x AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type = 'error' AS failed, event_id % 5 <> 0 AS told FROM events),
        e AS (SELECT *, CASE WHEN told THEN t + (event_id % 1000 - 100) * 60000000 ELSE t + 600000000 END AS until, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM x),
        f AS (SELECT event_id, user_id, k, t, CASE WHEN failed THEN until ELSE 0 END AS active, CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS failures FROM e WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.k, e.t, CASE WHEN e.failed AND (e.t >= f.active OR e.until > f.active) THEN e.until ELSE f.active END, CASE WHEN e.failed THEN f.failures + 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT event_id, active <= t AS available, CASE WHEN active > t THEN active END AS active_until, failures FROM f""",
    "j11_returned_slots": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_id % 3 <> 0 AS sent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        f AS (SELECT event_id, user_id, k, t AS began, CASE WHEN sent THEN 1 ELSE 0 END AS used, true AS accepted FROM e WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t >= f.began + 172800000000 THEN e.t ELSE f.began END,
          CASE WHEN e.t >= f.began + 172800000000 THEN CASE WHEN sent THEN 1 ELSE 0 END WHEN f.used < 3 AND sent THEN f.used + 1 ELSE f.used END, e.t >= f.began + 172800000000 OR f.used < 3 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT event_id, accepted FROM f""",
}

QUERIES = {name: globals()[name] for name in SQL}
