"""Pages, questions and citations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import html, markdown, murmur, urls
from docloom.operators import sparse
from docloom.plans import query_parse
from docloom.sources import files
from docloom.tables import read, settled


def a10_a11_page_links(spark, sf_dir):
    return html.page_links(read(spark, sf_dir, "pages"))


def h40_b9_page_texts(spark, sf_dir):
    return html.page_texts(read(spark, sf_dir, "pages"))


def a3_crawl(spark, sf_dir):
    """A site of a page per id, with links to two others."""
    ids = read(spark, sf_dir, "pages").select("page_id")
    url = lambda n: F.concat(F.lit("https://site.example.org/"), n.cast("string"))
    links = ids.select(url(F.col("page_id")).alias("source"), F.explode(F.array(url(F.col("page_id") * 2 % 251), url((F.col("page_id") * 3 + 1) % 400))).alias("target"))
    return files.crawl(links, "https://site.example.org/1")


def a3_page_crawl(spark, sf_dir):
    """The links of the pages, from the first URL and within its origin."""
    pages = read(spark, sf_dir, "pages")
    start = pages.select(urls.without_fragment(F.col("url")).alias("url")).where("url LIKE 'http%://%'").agg(F.min("url")).first()[0]
    links = html.page_links(pages).join(pages.select("page_id", urls.without_fragment(F.col("url")).alias("source")), "page_id")
    return files.crawl(links.select("source", F.col("link").alias("target")), start, re.match("[a-z]+://[^/?#]*", start)[0])


def page_words(spark, sf_dir):
    """(source, via, at), (via, target, of), (requested, url): links by their last word, pages by the words of their titles; every URL that ends in 2 or 7 ends where that with 1 does."""
    pages = read(spark, sf_dir, "pages").select("page_id", "html", urls.without_fragment(F.col("url")).alias("url")).where("url LIKE '%://%'")
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)", 1))
    titled = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(title, F.lit(r"[\p{L}]+"), F.lit(0)))).alias("via"), F.col("url").alias("target"), F.col("page_id").alias("of"))
    links = html.page_links(pages).select("page_id", "position", F.lower(F.regexp_extract("link", "([^/]*)$", 1)).alias("via")).join(pages.select("page_id", F.col("url").alias("source")), "page_id")
    return links.select("source", "via", F.col("position").cast("long").alias("at")), titled, pages.select(F.col("url").alias("requested")).where("requested LIKE '%2' OR requested LIKE '%7'").distinct().select("requested", F.regexp_replace("requested", "[27]$", "1").alias("url"))


def page_graph(spark, sf_dir):
    """(source, target, at), (requested, url): every pair of pages of which the first has a link whose last word is in the second's title. Its size is the square of the pages'."""
    links, titled, ends = page_words(spark, sf_dir)
    return links.join(titled, "via").groupBy("source", "target").agg(F.min(F.col("at") * 1_000_000_000 + F.col("of")).alias("at")), ends


def a3_crawl_order(spark, sf_dir):
    """The first 60 requests of a crawl of the pages by a queue, from the first URL that has a link to a page. A link leads to the pages whose titles have its last word."""
    links, titled, ends = page_words(spark, sf_dir)
    links, titled = settled(links, "page-links"), settled(titled, "titles")
    start = links.join(titled.select("via").distinct(), "via", "left_semi").agg(F.min("source")).first()[0]
    return files.crawl_in_order(links, start, ends, limit=60, through=titled)


def h39h_mirror_paths(spark, sf_dir):
    u = F.regexp_replace(F.replace("url", F.lit("http://"), F.lit("https://")), r"#.*$", "")
    return read(spark, sf_dir, "pages").select("page_id", files.mirror_path(u).alias("path"), files.mirror_path(u, 1).alias("cut_path"))


def h39i_seed_urls(spark, sf_dir):
    return files.seed_urls(read(spark, sf_dir, "pages"), "https://blog.", "https://docs.", r"/de/")


def d17_distinct_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).distinct()


def h7_term_indexes(spark, sf_dir):
    return murmur.term_indexes(read(spark, sf_dir, "benchmark").select(F.explode(sparse.terms(F.col("text"))).alias("term")))


QUESTIONS = ["Compare Java 24 with JDK 21 and Java SE 24", "Java 21/24/25 streams", "What does List.of(E, E) return?", "java.util.Map::entry or Map.of()", "plain question", None]


def h25_h30_questions(spark, sf_dir):
    kind = pa.struct([("versions", pa.string()), ("boosted", pa.string()), ("lexical", pa.string()), ("member", pa.string()), ("signature", pa.string())])

    def judge(q):
        versions, m = query_parse.requested_versions(q, ["21", "24", "25"]), query_parse.unique_member(q)
        return {"versions": ",".join(versions), "boosted": query_parse.boosted(q or "", versions), "lexical": query_parse.citation_query(q or ""), "member": m and f"{m.type}.{m.method}", "signature": m and m.signature}

    rows = read(spark, sf_dir, "benchmark").select("item_id", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("item_id") % len(QUESTIONS) + 1).cast("int")).alias("q"))
    out = html.map_pages(rows, "item_id", ["q"], judge, "x", kind, "struct<versions:string,boosted:string,lexical:string,member:string,signature:string>")
    return out.select("item_id", "x.*")


def h46_h48_markdown(spark, sf_dir):
    md = F.concat(F.lit("intro [a](https://x.org/a)\n# One\n"), F.col("text"), F.lit("\n```\n# no\n{{hint:no}}\n```\n## Two\n{{hint: be careful }} and ![i](x.png) [m](mailto:x) [1]\n"))
    kind = pa.struct([("sections", pa.int64()), ("links", pa.string()), ("hints", pa.string())])
    judge = lambda t: {"sections": len(markdown.sections(t)), "links": "|".join(u for _, _, u in markdown.citations(t)), "hints": "|".join(f"{k}:{x}" for k, x, _ in markdown.hints(t))}
    rows = read(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    return html.map_pages(rows, "doc_id", ["md"], judge, "x", kind, "struct<sections:bigint,links:string,hints:string>").select("doc_id", "x.*")


SQL = {
    "h7_term_indexes": r"""WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) WHERE length(term) >= 2),
        b AS (SELECT term, list_transform(range(strlen(term)), lambda i: CAST('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM t),
        w AS (SELECT term, len(b) AS n, list_transform(range((len(b) + 3) // 4), lambda i: b[4 * i + 1] + coalesce(b[4 * i + 2], 0) * 256 + coalesce(b[4 * i + 3], 0) * 65536 + coalesce(b[4 * i + 4], 0) * 16777216) AS w FROM b),
        c AS (SELECT term, n, list_transform(w, lambda x: CAST(x::HUGEINT * 3432918353 % 4294967296 AS BIGINT)) AS w FROM w),
        r AS (SELECT term, n, list_transform(w, lambda x: CAST((((x << 15) & 4294967295) | (x >> 17))::HUGEINT * 461845907 % 4294967296 AS BIGINT)) AS k FROM c),
        f AS (SELECT term, n, k, list_reduce([0::BIGINT] || k[1:n // 4], lambda h, k: ((((xor(h, k) << 13) & 4294967295) | (xor(h, k) >> 19)) * 5 + 3864292196) % 4294967296) AS h FROM r),
        m AS (SELECT term, xor(CASE WHEN n % 4 > 0 THEN xor(h, k[n // 4 + 1]) ELSE h END, n) AS h FROM f),
        m1 AS (SELECT term, CAST(xor(h, h >> 16)::HUGEINT * 2246822507 % 4294967296 AS BIGINT) AS h FROM m),
        m2 AS (SELECT term, CAST(xor(h, h >> 13)::HUGEINT * 3266489909 % 4294967296 AS BIGINT) AS h FROM m1)
        SELECT term, xor(h, h >> 16) AS "index" FROM m2""",
    "a3_crawl": """WITH RECURSIVE e AS (SELECT page_id AS s, page_id * 2 % 251 AS t FROM pages UNION SELECT page_id, (page_id * 3 + 1) % 400 FROM pages),
        r AS (SELECT 1::BIGINT AS n, 0 AS level UNION SELECT t, level + 1 FROM r JOIN e ON s = n WHERE level < 60) SELECT 'https://site.example.org/' || n AS url, min(level) AS level FROM r GROUP BY n""",
    "h39h_mirror_paths": r"""WITH x AS (SELECT page_id, regexp_replace(replace(url, 'http://', 'https://'), '#.*$', '') AS u FROM pages), y AS (SELECT *, regexp_extract(u, '^https://[^/]+(/.*)?$', 1) AS p FROM x),
        z AS (SELECT page_id, CASE WHEN u LIKE '%?%' THEN NULL WHEN p IN ('', '/') THEN 'index.html' WHEN p LIKE '%/' THEN substr(p, 2) || 'index.html' WHEN regexp_matches(p, '\.html?$') THEN substr(p, 2) ELSE substr(p, 2) || '.html' END AS path FROM y)
        SELECT page_id, path, CASE WHEN path LIKE '%/%' THEN substr(path, strpos(path, '/') + 1) ELSE path END AS cut_path FROM z""",
    "h39i_seed_urls": "SELECT DISTINCT 'https://docs.' || substr(u, 14) AS url FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u FROM pages) WHERE u LIKE 'https://blog.%' AND u NOT LIKE '%/de/%'",
    "d17_distinct_hosts": "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages",
}

QUERIES = {name: globals()[name] for name in ["a10_a11_page_links", "h40_b9_page_texts", *SQL, "h25_h30_questions", "h46_h48_markdown", "a3_page_crawl", "a3_crawl_order"]}
