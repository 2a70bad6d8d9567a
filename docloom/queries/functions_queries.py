"""Scalar functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import identity, text, urls
from docloom.operators import sparse
from docloom.tables import read

#: Documents as pages of a site, with a release and a collection; SQL for the same.
CORPUS_SQL = """
corpus AS (
  SELECT doc_id, text, lang, source, n_chars, 'https://docs.example.org/' || source || '/' || doc_id || '.html' AS url,
    ['21', '24', '25'][1 + doc_id % 3] AS version, ['articles', 'books', 'docs', 'pdfs'][1 + doc_id % 4] AS collection
  FROM documents)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    url = F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html"))
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", url.alias("url"), pick(["21", "24", "25"]).alias("version"), pick(["articles", "books", "docs", "pdfs"]).alias("collection"))


def h1_h3_chunk_hash(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", identity.sha256(F.col("text")).alias("text_hash"), identity.chunk_hash(F.col("url"), F.col("doc_id") % 7, F.col("text")).alias("chunk_hash"))


def h4_member_hash(spark, sf_dir):
    c = corpus(spark, sf_dir)
    anchor = F.concat(F.lit("of("), "lang", F.lit(")"))
    return c.select("doc_id", identity.member_chunk_hash(F.col("url"), F.col("doc_id") % 7, anchor, F.col("text")).alias("member_hash"))


def h6_point_uuid(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", identity.uuid_from_hash(identity.sha256(F.col("text"))).alias("point_id"))


def h8_safe_name(spark, sf_dir):
    long_url = F.concat("url", F.repeat(F.lit("/é?segment"), 12))
    return read(spark, sf_dir, "pages").select("page_id", identity.safe_name(F.col("url")).alias("name"), identity.safe_name(long_url).alias("long_name"))


def h9_h10_fingerprints(spark, sf_dir):
    c = corpus(spark, sf_dir)
    head = F.col("text")
    payload = identity.marker_payload(F.concat(F.lit(" "), head), F.col("source"))
    rows = c.select("doc_id", head.alias("title"), "source", identity.provenance_fingerprint(F.col("source"), F.col("url"), F.col("lang"), F.col("version"), head).alias("fingerprint"), payload.alias("payload"))
    back = identity.marker_fields(F.col("payload"))
    return rows.select("doc_id", "fingerprint", F.sha2("payload", 256).alias("payload_hash"), ((back["title"] == F.trim("title")) & (back["package"] == F.col("source"))).alias("reads_back"))


def h11_h15_text_measures(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(text.ascii_lower(t), 256).alias("lower_hash"),
        text.estimated_tokens(t).alias("tokens"),
        text.has_visible_content(t).alias("visible"),
        text.first_number(t).alias("first_number"),
        F.length(text.drop_control_characters(F.concat(t, F.lit("\x07\x85\t")))).cast("long").alias("clean_chars"),
        text.utf16_length(F.concat(t, F.lit("😀"))).cast("long").alias("utf16_units"),
    )


def h12_standard_terms(spark, sf_dir):
    """Terms by the standard's word breaks, of the documents with marks between some of their words."""
    marked = F.col("text")
    for old, new in ((" a", "'a"), (" th", ".th"), (" in ", "_in_"), (" el ", " 3.14,5x; "), (" d", ",d")):
        marked = F.replace(marked, F.lit(old), F.lit(new))
    return sparse.term_frequencies(read(spark, sf_dir, "documents").select("doc_id", marked.alias("text")), "doc_id", split=sparse.standard_terms)


def h17_h18_keyword_score(spark, sf_dir):
    words = F.array(F.lit("the"), F.lit("en"), F.lit("de"))
    low = text.ascii_lower(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.occurrences(low, F.lit("the")).alias("hits"), F.round(text.keyword_score(low, words), 9).alias("score"))


def h20_h21_h23_cuts(spark, sf_dir):
    t = F.concat((F.col("doc_id") % 9).cast("string"), F.lit("\n\n"), "text", F.lit("\r\n"))
    return read(spark, sf_dir, "documents").select("doc_id", text.cut_with_ellipsis(t, 500).alias("snippet"), text.failure_details(t).alias("details"))


def h22_token_cut(spark, sf_dir):
    cut = text.truncated(F.col("text"), 100)
    rows = read(spark, sf_dir, "documents").select("doc_id", cut.alias("cut"))
    return rows.select("doc_id", F.sha2("cut.text", 256).alias("text_hash"), F.length("cut.text").cast("long").alias("chars"), "cut.truncated", F.col("cut.original_length").cast("long").alias("original_length"))


def h58_h59_token_lists(spark, sf_dir):
    parts = F.split("text", "[,.]")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(text.trimmed_distinct(parts), "|"), 256).alias("distinct_parts"), F.size(text.trimmed_filled(parts)).cast("long").alias("filled"))


def b8_route(spark, sf_dir):
    c = corpus(spark, sf_dir)
    doc_set = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" Books/"), "source")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("ibm/articles/"), "source")).otherwise(F.col("source"))
    path = F.when(F.col("doc_id") % 7 == 0, F.lit("a/B.PDF ")).otherwise(F.lit("a/b.html"))
    kind = F.when(F.col("doc_id") % 11 == 0, F.lit("Blog")).when(F.col("doc_id") % 11 == 1, F.lit("pdf"))
    return c.select("doc_id", urls.collection_of(doc_set, path, kind, F.col("url")).alias("routed"))


def h33_canonical_url(spark, sf_dir):
    site = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://[^/?#]*", "https://docs.spring.io")).otherwise(F.col("url"))
    doubled = F.concat(F.replace(site, F.lit("/en/"), F.lit("/en/docs/api/api//x//")), F.lit("/api/api/spring-framework/docs/current/javadoc-api/java/y"))
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_doc_url(doubled).alias("canonical"), urls.without_fragment(F.col("url")).alias("plain"), urls.terminal_page(F.col("url")).alias("page"))


def h39k_citation_type(spark, sf_dir):
    u = F.when(F.col("page_id") % 6 == 0, F.concat("url", F.lit(".PDF"))).when(F.col("page_id") % 6 == 1, F.concat("url", F.lit("/api/x"))).when(F.col("page_id") % 6 == 2, F.replace("url", F.lit("example.com"), F.lit("github.com"))).when(F.col("page_id") % 6 == 3, F.lit("/local")).when(F.col("page_id") % 6 == 4, F.lit("mailto:x"))
    u = u.otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", urls.citation_type(u).alias("citation_type"), urls.is_citable(u).alias("citable"))


def h39c_h39f_repository_names(spark, sf_dir):
    c = corpus(spark, sf_dir)
    path = F.concat(F.lit("src/é dir/"), "lang", F.lit("/A+b "), F.col("doc_id").cast("string"), F.lit(".java"))
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("My Repo_")).otherwise(F.lit("repo-")), F.col("doc_id").cast("string"))
    return c.select("doc_id", urls.repository_file_url(F.lit("https://code.example.org/x"), F.col("version"), path).alias("file_url"), urls.repository_identity(name).alias("identity"), urls.collection_segment(name).alias("segment"))


FILE_NAMES = ["A.java", "b.GRADLE.kts", "c.kts", "Dockerfile", "CMakeLists.txt", "d.md", "e", "f.unknown", "g.YML", "h.h", "i.tar.gz", "j."]
#: Put before words of the documents, so that order and case decide.
LICENSES = ["MIT License", "Apache License Version 2.0", "GNU LGPL v3", "GNU AGPL", "GPL version 2", "BSD 3-Clause", "permit me", "ISC", "MPL 2", "LGPL", "The Unlicense", "mit", "All rights reserved"]


def h39d_h39g_file_kinds(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", pick(FILE_NAMES).alias("file"), F.concat(pick(LICENSES), F.lit(" "), F.substring_index("text", "\n", 1)).alias("line"))
    return rows.select("doc_id", urls.language_of_file(F.col("file")).alias("language"), urls.doc_type_of_file(F.col("file")).alias("doc_type"), urls.license_of(F.col("line")).alias("license"))


def h39_java_package(spark, sf_dir):
    root = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("https://docs.oracle.com/en/java/javase/"), (21 + F.col("doc_id") % 6).cast("string"), F.lit("/docs/api/java.base/"))).otherwise(F.lit("https://docs.example.org/docs/api/java.base/"))
    below = F.concat(F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("/"), "source")), F.lit("/List.html?x=/a/b#of()"))
    page = F.concat("text", F.lit(" Package "), F.substring("text", 1, 40), F.lit(" JAVA."), "lang", F.lit(".x, java.util;"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(root, below).alias("url"), page.alias("page"))
    return rows.select("doc_id", urls.java_package_of_url(F.col("url")).alias("of_url"), urls.java_package(F.col("url"), F.col("page")).alias("package"))


def b21_crawl_boundary(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.in_crawl_boundary(F.col("url"), "https://tionsh.example.net/en").alias("inside"))


LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
B64 = "to_base64(encode({}))"
B64URL = "translate(to_base64(encode({})), '+/=', '-_')"
UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || ['8', '9', 'a', 'b'][1 + CAST('0x' || substr(m, 17, 1) AS INT) % 4] || substr(m, 18, 3) || '-' || substr(m, 21, 12)"
SAFE = "CASE WHEN length(p) > 150 THEN left(p, 80) || '_' || left(sha256({u}), 12) || '_' || right(p, 40) ELSE p END"
LANGUAGES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in urls.LANGUAGE_OF_ENDING.items()) + "}"
NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in urls.LANGUAGE_OF_NAME.items()) + "}"

SQL = {
    "h12_standard_terms": r"""WITH m AS (SELECT doc_id, lower(replace(replace(replace(replace(replace(text, ' a', '''a'), ' th', '.th'), ' in ', '_in_'), ' el ', ' 3.14,5x; '), ' d', ',d')) AS t FROM documents),
        w AS (SELECT doc_id, unnest(regexp_extract_all(t, '_*(?:\pL\pM*(?:[:.'']?\pL\pM*)*|\p{Nd}\pM*(?:[,;.'']?\p{Nd}\pM*)*)+(?:_+(?:\pL\pM*(?:[:.'']?\pL\pM*)*|\p{Nd}\pM*(?:[,;.'']?\p{Nd}\pM*)*)+)*_*')) AS term FROM m)
        SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY 1, 2""",
    "h1_h3_chunk_hash": f"WITH {CORPUS_SQL} SELECT doc_id, sha256(text) AS text_hash, sha256(url || '#' || doc_id % 7 || ':' || text) AS chunk_hash FROM corpus",
    "h4_member_hash": f"""WITH {CORPUS_SQL}, x AS (SELECT *, 'of(' || lang || ')' AS anchor, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM corpus)
        SELECT doc_id, sha256(concat_ws(chr(0), 'java-api-member-chunk-v2', length(url), url, doc_id % 7, length(anchor), anchor, units, text)) AS member_hash FROM x""",
    "h6_point_uuid": f"SELECT doc_id, {UUID} AS point_id FROM (SELECT doc_id, md5(sha256(text)) AS m FROM documents)",
    "h8_safe_name": f"""SELECT page_id, {SAFE.format(u='url')} AS name, {SAFE.format(u='l').replace('p)', 'q)').replace('(p,', '(q,').replace('ELSE p', 'ELSE q')} AS long_name FROM
        (SELECT page_id, url, l, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS p, regexp_replace(l, '[^a-zA-Z0-9._-]', '_', 'g') AS q FROM (SELECT *, url || repeat('/é?segment', 12) AS l FROM pages))""",
    "h9_h10_fingerprints": f"""WITH {CORPUS_SQL} SELECT doc_id, sha256(concat_ws('.', {', '.join(B64URL.format(x) for x in ('source', 'url', 'lang', 'version', 'text'))})) AS fingerprint,
        sha256('1' || chr(10) || 'titleB64=' || {B64.format("trim(' ' || text)")} || chr(10) || 'packageB64=' || {B64.format('source')} || chr(10)) AS payload_hash, true AS reads_back FROM corpus""",
    "h11_h15_text_measures": f"""SELECT doc_id, sha256({LOW}) AS lower_hash, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + 1 END AS tokens, regexp_matches(text, '\\S') AS visible,
        regexp_extract(text, '([0-9]+)', 1) AS first_number, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')) + 1 AS clean_chars,
        length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 2 AS utf16_units FROM documents""",
    "h17_h18_keyword_score": f"""WITH x AS (SELECT doc_id, {LOW} AS t FROM documents), n AS (SELECT doc_id, length(t) AS len, (length(t) - length(replace(t, 'the', ''))) // 3 AS a, (length(t) - length(replace(t, 'en', ''))) // 2 AS b, (length(t) - length(replace(t, 'de', ''))) // 2 AS c FROM x)
        SELECT doc_id, a AS hits, round((a + b + c) / greatest(50, len), 9) AS score FROM n""",
    "h20_h21_h23_cuts": """WITH x AS (SELECT doc_id, text, regexp_replace(translate(text, chr(13) || chr(10), '  '), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS f FROM (SELECT doc_id, doc_id % 9 || chr(10) || chr(10) || text || chr(13) || chr(10) AS text FROM documents))
        SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS snippet, CASE WHEN length(f) > 240 THEN left(f, 240) || '...' ELSE f END AS details FROM x""",
    "h22_token_cut": """WITH x AS (SELECT doc_id, text, left(text, 400) AS h FROM documents),
        y AS (SELECT *, 400 - least(CASE WHEN contains(h, '.') THEN strpos(reverse(h), '.') ELSE 401 END, CASE WHEN contains(h, chr(10)) THEN strpos(reverse(h), chr(10)) ELSE 401 END) AS p FROM x),
        z AS (SELECT doc_id, length(text) > 400 AS o, length(text) AS n, CASE WHEN length(text) > 400 THEN CASE WHEN p > 320 THEN left(h, p + 1) ELSE h END || chr(10) || '[...content truncated for token limits...]' ELSE text END AS t FROM y)
        SELECT doc_id, sha256(t) AS text_hash, length(t) AS chars, o AS truncated, n AS original_length FROM z""",
    "h58_h59_token_lists": """WITH f AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,.]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
        n AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM f) GROUP BY 1, 2),
        g AS (SELECT doc_id, string_agg(x, '|' ORDER BY i) AS p FROM n GROUP BY 1)
        SELECT f.doc_id, sha256(coalesce(p, '')) AS distinct_parts, len(l) AS filled FROM f LEFT JOIN g USING (doc_id)""",
    "b8_route": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'books' WHEN doc_id % 11 = 0 OR doc_id % 5 = 1 THEN 'articles' WHEN doc_id % 7 = 0 OR doc_id % 11 = 1 THEN 'pdfs' ELSE 'docs' END AS routed FROM documents""",
    "h33_canonical_url": r"""WITH w AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^[a-z]+://[^/?#]*', 'https://docs.spring.io') ELSE url END AS s FROM pages),
        x AS (SELECT page_id, url, replace(s, '/en/', '/en/docs/api/api//x//') || '/api/api/spring-framework/docs/current/javadoc-api/java/y' AS u FROM w),
        z AS (SELECT *, replace(replace(u, '/docs/api/api/', '/docs/api/'), '/api/api/', '/api/') AS t FROM x),
        y AS (SELECT *, CASE WHEN contains(t, 'https://docs.spring.io/') THEN replace(t, '/spring-framework/docs/current/javadoc-api/java/', '/spring-framework/docs/current/javadoc-api/') ELSE t END AS v FROM z)
        SELECT page_id, CASE WHEN strpos(v, '://') > 0 THEN left(v, strpos(v, '://') + 2) || regexp_replace(substr(v, strpos(v, '://') + 3), '/+', '/', 'g') ELSE regexp_replace(v, '/+', '/', 'g') END AS canonical, split_part(url, '#', 1) AS plain,
        nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+\.html)$', 1), '') AS page FROM y""",
    "h39k_citation_type": """WITH x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '/api/x' WHEN 2 THEN replace(url, 'example.com', 'github.com') WHEN 3 THEN '/local' WHEN 4 THEN 'mailto:x' ELSE url END AS u FROM pages)
        SELECT page_id, CASE WHEN lower(u) LIKE '%.pdf' THEN 'pdf-document' WHEN u LIKE 'http%' AND (u LIKE '%docs.oracle.com%' OR u LIKE '%javadoc%' OR u LIKE '%/api/%') THEN 'api-documentation'
        WHEN u LIKE 'http%' AND u LIKE '%github.com%' THEN 'code-repository' WHEN u LIKE 'http%' THEN 'external-link' WHEN u LIKE '/%' THEN 'local-link' ELSE 'unknown' END AS citation_type, u NOT LIKE 'mailto:%' AS citable FROM x""",
    "h39c_h39f_repository_names": f"""WITH {CORPUS_SQL}, x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'My Repo_' ELSE 'repo-' END || doc_id AS n FROM corpus)
        SELECT doc_id, 'https://code.example.org/x/blob/' || version || '/src/%C3%A9%20dir/' || lang || '/A%2Bb%20' || doc_id || '.java' AS file_url, CASE WHEN regexp_full_match(lower(n), '[a-z0-9._-]+') THEN lower(n) END AS identity,
        CASE WHEN doc_id % 2 = 0 THEN 'my-repo-' || doc_id || '-h' || left(sha256(n), 8) ELSE n END AS segment FROM x""",
    "h39d_h39g_file_kinds": f"""WITH x AS (SELECT doc_id, lower({FILE_NAMES}[1 + doc_id % {len(FILE_NAMES)}]) AS f, {LICENSES}[1 + doc_id % {len(LICENSES)}] || ' ' || split_part(text, chr(10), 1) AS l FROM documents), y AS (SELECT *, regexp_extract(f, '(\\.[^.]*)$', 1) AS e FROM x)
        SELECT doc_id, coalesce({NAMES}[f], CASE WHEN f LIKE '%.gradle.kts' THEN 'kotlin' END, {LANGUAGES}[e], '') AS language,
        CASE WHEN f IN ({str(list(urls.LANGUAGE_OF_NAME))[1:-1]}) THEN 'configuration' WHEN e IN ({str(urls.DOCUMENTATION_ENDINGS)[1:-1]}) THEN 'documentation' WHEN e IN ({str(urls.CONFIGURATION_ENDINGS)[1:-1]}) THEN 'configuration' ELSE 'source-code' END AS doc_type,
        CASE WHEN l LIKE '%MIT%' THEN 'MIT' WHEN l LIKE '%Apache%2%' THEN 'Apache-2.0' WHEN l LIKE '%GPL%3%' THEN 'GPL-3.0' WHEN l LIKE '%GPL%2%' THEN 'GPL-2.0' WHEN l LIKE '%BSD%3%' THEN 'BSD-3-Clause' WHEN l LIKE '%BSD%2%' THEN 'BSD-2-Clause'
          WHEN l LIKE '%ISC%' THEN 'ISC' WHEN l LIKE '%MPL%2%' THEN 'MPL-2.0' WHEN l LIKE '%LGPL%' THEN 'LGPL-3.0' WHEN l LIKE '%AGPL%' THEN 'AGPL-3.0' WHEN l LIKE '%Unlicense%' THEN 'Unlicense' ELSE '' END AS license FROM y""",
    "h39_java_package": r"""WITH x AS (SELECT doc_id, (doc_id % 3 < 2 AND 21 + doc_id % 6 IN (21, 24, 25)) AS registered, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '.' || source END AS p,
          text || ' Package ' || left(text, 40) || ' JAVA.' || lang || '.x, java.util;' AS t FROM documents),
        y AS (SELECT doc_id, CASE WHEN registered AND regexp_full_match(p, '[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+') THEN p ELSE '' END AS of_url, list_filter(regexp_split_to_array(substr(t, strpos(t, 'Package '), 100), '\s+'), lambda w: starts_with(lower(w), 'java.'))[1] AS w FROM x),
        z AS (SELECT *, regexp_replace(w, '[,.;]$', '') AS n FROM y)
        SELECT doc_id, of_url, CASE WHEN of_url <> '' THEN of_url WHEN regexp_full_match(n, '[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*') THEN n ELSE '' END AS package FROM z""",
    "b21_crawl_boundary": r"SELECT page_id, regexp_matches(url, '^https://tionsh\.example\.net/en($|[/?#])') AS inside FROM pages",
}

QUERIES = {name: globals()[name] for name in SQL}
