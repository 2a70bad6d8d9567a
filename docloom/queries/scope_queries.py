"""Retrieval and citations for a table of questions, each under its own constraint, and SQL with the conditions written out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import dense, retrieval, sparse
from docloom.plans import scopes as predicate
from docloom.queries.functions_queries import CORPUS_SQL, corpus
from docloom.queries.retrieval_queries import TERMS, searched
from docloom.tables import read, settled

API_SETS = {"21": "src0", "24": "src6", "25": "src12"}
TOP_K, PREFETCH, RETURN_K, CITATIONS = 8, 14, 6, 3


def _of(letter, n):
    """How often a text has the letter, modulo n."""
    return (F.length("text") - F.length(F.replace("text", F.lit(letter), F.lit("")))) % n


def _pick(names, at):
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


TYPE, METHOD, SIGNATURE = ["List", "Map", "Set"], ["of", "entry", "get"], ["(E,E)", "()", "(K,V)"]


def entries(spark, sf_dir):
    """Documents as entries of members: releases and sets by source, the rest by what their texts hold. Made once."""
    kind, package = _pick(TYPE, F.length("text") % 3), F.when((F.length("text") % 3 == 2) & (_of("o", 2) == 1), "org.other").otherwise("java.util")
    number = F.substring("source", 4, 9).cast("int")
    return settled(
        corpus(spark, sf_dir)
        .withColumn("version", F.when(number < 6, "21").when(number < 12, "24").when(number < 18, "25").otherwise(""))
        .select(
            "doc_id", "version", F.col("source").alias("doc_set"), (_of("u", 2) == 0).alias("talks"),
            F.when(_of("e", 4) != 0, "official").otherwise("community").alias("source_kind"), F.when(_of("i", 3) != 0, "api-docs").otherwise("guide").alias("doc_type"),
            F.concat(F.lit("name"), (F.length("text") % 2).cast("string")).alias("source_name"), _pick(["docs", "pdfs", "docs", "books"], _of("n", 4)).alias("collection"),
            F.concat(kind, F.lit(".html")).alias("type_page"), package.alias("package"), F.concat(_pick(METHOD, _of("e", 3)), _pick(SIGNATURE, _of("a", 3))).alias("anchor"),
            F.concat(F.lit("https://docs.example.org/"), F.replace(package, F.lit("."), F.lit("/")), F.lit("/"), kind, F.lit(".html")).alias("url"), F.sha2("text", 256).alias("hash"),
        ),
        "entries",
    )


def questions(spark, sf_dir):
    """The benchmark's texts as questions: what is asked for and under which constraint is in their lengths and letters."""
    member = F.concat(_pick(TYPE, _of("t", 3)), F.lit("."), _pick(METHOD, _of("h", 3)))
    n, none = F.length("text") % 6, F.array().cast("array<string>")
    asked = F.when(n == 0, F.concat("text", F.lit(" in Java 21 and 25?"))).when(n == 1, F.concat(F.lit("JDK 24: "), "text"))
    asked = asked.when(n == 2, F.concat("text", F.lit(" What does java.util."), member, _pick(["(E, E)", "()", "(K, V)"], _of("s", 3)), F.lit(" do in Java 21?"))).when(n == 3, F.concat("text", F.lit(" How is "), member, F.lit(" used?")))
    asked = asked.when(n == 4, F.concat("text", F.lit(" "), member, F.lit(" or Deque.peek, vs Java 24 + 21"))).otherwise(F.col("text"))
    sets = F.when((_of("a", 3) == 0) | n.isin(2, 3), F.array(*(F.lit(f"src{i}") for i in (0, 1, 6, 12, 13)))).when(_of("a", 3) == 1, F.array(*(F.lit(f"src{i}") for i in range(18)))).otherwise(none)
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query"),
        asked.alias("text"),
        F.when(_of("i", 7) == 0, F.array(F.lit("21"), F.lit(" 25 "))).otherwise(none).alias("doc_versions"),
        sets.alias("doc_sets"),
        F.when(_of("e", 2) == 0, " official").otherwise("").alias("source_kind"),
        F.when(_of("o", 5) == 0, "api-docs").alias("doc_type"),
        F.when(_of("r", 9) == 0, "name1").alias("source_name"),
    )


def platform(points):
    """Members that the platform declares, by its documents of one kind."""
    return points.where("doc_type = 'api-docs'").select("package", F.regexp_extract("type_page", "^(.*)[.]html$", 1).alias("type"), F.regexp_extract("anchor", "^([^(]+)", 1).alias("method")).distinct()


def slots(points, scopes):
    """(doc_id, slots): the scopes, as slots, that each document lies in; and scopes with their slot, 100 times the query plus the scope."""
    slotted = scopes.withColumn("slot", F.col("query") * 100 + F.col("scope"))
    inside = predicate.in_scopes(points.select("doc_id", *retrieval.FIELDS), slotted, retrieval.FIELDS, ["slot"])
    return inside.groupBy("doc_id").agg(F.collect_set("slot").alias("slots")), slotted


def word_scopes(spark, sf_dir, asked, points, scopes):
    """(query, scope, doc_id, score, rank): the documents of each scope that isn't exact by terms shared with its question. Documents are scored where they lie, for the scopes that they lie in."""
    lists, slotted = slots(points, scopes.where("NOT exact"))
    terms = settled(sparse.term_frequencies(asked.select("query", "search_text"), "query", "search_text"), "terms")
    found, weight = searched(spark, sf_dir, read(spark, sf_dir, "documents"), terms, most=sparse.MOST_TERMS)
    queries = terms.join(slotted.select("query", "slot"), "query")
    best = sparse.document_scores(found.join(lists, "doc_id"), queries, weight, "slot", "doc_id", max(TOP_K, PREFETCH), inside="slots")
    ranked = sparse.top_k(best, "slot", "doc_id", max(TOP_K, PREFETCH))
    return settled(ranked.select(F.floor(F.col("slot") / 100).alias("query"), (F.col("slot") % 100).cast("int").alias("scope"), "doc_id", "score", "rank"), "words")


def asked_for(spark, sf_dir, points):
    """Made once, as every part of a search reads it."""
    return settled(retrieval.plan_questions(questions(spark, sf_dir), platform(points), API_SETS), "asked")


def h25_i9_asked(spark, sf_dir):
    """What each question asks for, as it is planned."""
    asked = asked_for(spark, sf_dir, entries(spark, sf_dir))
    return asked.select(
        "query", F.sha2("text", 256).alias("question_hash"), F.array_join("requested", ",").alias("requested"), F.concat("first_member.type", F.lit("."), "first_member.method").alias("first_member"),
        F.col("member.package").alias("package"), F.col("member.signature").alias("signature"), "path", F.col("failure").isNotNull().alias("conflict"), F.sha2("search_text", 256).alias("search_hash"), F.array_join("doc_sets", ",").alias("doc_sets"),
    )


def i6_question_scopes(spark, sf_dir):
    """All documents that each question's scopes admit, counted by scope, with digests of their ids."""
    points = entries(spark, sf_dir)
    asked = asked_for(spark, sf_dir, points)
    inside = predicate.in_scopes(points.select("doc_id", *retrieval.FIELDS), retrieval.question_scopes(asked), retrieval.FIELDS, ["query", "scope"])
    return inside.groupBy("query", "scope").agg(F.count(F.lit(1)).alias("documents"), F.sum("doc_id").alias("ids"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def dense_scopes(spark, sf_dir, points, scopes):
    """(query, scope, doc_id, score, rank): the vectors nearest to each hybrid scope's question; question n has the vector 20 n."""
    vectors = read(spark, sf_dir, "embeddings")
    lists, hybrid = slots(points, scopes.where("path = 'hybrid'"))
    rows = vectors.join(lists, F.col("vec_id") == F.col("doc_id"))
    own = vectors.select(F.col("vec_id").alias("at"), "embedding").join(hybrid.select("slot", (F.col("query") * 20).alias("of")), F.col("at") == F.col("of")).select(F.col("slot").alias("vec_id"), "embedding")
    near = dense.dense_top_k(rows, own, PREFETCH, inside="slots")
    return near.select(F.floor(F.col("query") / 100).alias("query"), (F.col("query") % 100).cast("int").alias("scope"), F.col("vec_id").alias("doc_id"), "score", "rank")


def i6_i10_retrieval(spark, sf_dir):
    """Each question's context: hybrid by releases, or a member's own entries; first seen, covered, cut to 100 tokens."""
    points = entries(spark, sf_dir)
    asked = asked_for(spark, sf_dir, points)
    scopes = settled(retrieval.question_scopes(asked), "scopes")
    found = retrieval.candidates(asked, scopes, points, word_scopes(spark, sf_dir, asked, points, scopes), dense_scopes(spark, sf_dir, points, scopes), "doc_id", TOP_K, PREFETCH)
    rows = found.join(points.select("doc_id", "version", "doc_type", "type_page", "package", "anchor", "url", "hash"), "doc_id").join(asked.select("query", "member", "path"), "query")
    mine = retrieval.own_entry(F.col("member"), F.col("doc_type"), F.col("type_page"), F.col("package"), F.col("anchor"))
    # Members in the order in which they were found, others by score, in the place of a reranker.
    rows = retrieval.first_seen_of_questions(rows.where((F.col("path") == "hybrid") | mine), "version", "hash", "url")
    by = F.struct(F.when(F.col("path") == "hybrid", -F.col("score")).otherwise(0.0).alias("s"), "scope", "rank")
    rows = rows.withColumn("order", F.row_number().over(W.partitionBy("query").orderBy(by)))
    out = retrieval.context_texts(retrieval.answers(asked, rows, "doc_id", RETURN_K), read(spark, sf_dir, "documents"), "doc_id", "text", 100)
    return out.select("query", "failure", "place", "doc_id", "version", "score", F.sha2("text", 256).alias("text_hash"), "truncated")


def e4_i9_citation_order(spark, sf_dir):
    """Each question's first entries for citations: by words in official collections, in the order of what it names."""
    points = entries(spark, sf_dir)
    asked = retrieval.citation_questions(asked_for(spark, sf_dir, points))
    scopes = settled(retrieval.question_scopes(asked), "scopes")
    found = retrieval.candidates(asked, scopes, points, word_scopes(spark, sf_dir, asked, points, scopes), None, "doc_id", TOP_K, PREFETCH)
    said = F.concat_ws(" ", "text", F.when(F.col("talks"), F.concat(F.regexp_extract("anchor", "^([^(]+)", 1), F.lit(" (x)"))))
    more = points.join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "version", "doc_type", "type_page", "package", "anchor", "url", "hash", said.alias("text"), F.regexp_extract("url", "^https://[^/]+(/[^?#]*)", 1).alias("url_path"), F.col("package").alias("url_package"))
    rows = found.join(more, "doc_id").join(asked.select("query", "member", "first_member", "requested"), "query")
    # With releases the scopes' rows are one list, whose repeats go; a single scope's are as they are.
    fanned, single = rows.where(F.size("requested") > 0), rows.where(F.size("requested") == 0)
    ordered = retrieval.in_citation_order(retrieval.first_seen_of_questions(fanned, "version", "hash", "url").unionByName(single))
    out = retrieval.answers(asked.withColumn("path", F.lit("hybrid")), ordered, "doc_id", CITATIONS)
    return out.select("query", "failure", F.posexplode_outer("rows").alias("at", "row")).select("query", "failure", (F.col("at") + 1).alias("place"), "row.doc_id", "row.version")


def _count(letter, n, text="text"):
    return f"((length({text}) - length(replace({text}, '{letter}', ''))) % {n})"


ENTRIES_SQL = f"""
{CORPUS_SQL},
e0 AS (SELECT *, CAST(substr(source, 4) AS INTEGER) AS number, ['List', 'Map', 'Set'][1 + length(text) % 3] AS kind, CASE WHEN length(text) % 3 = 2 AND {_count('o', 2)} = 1 THEN 'org.other' ELSE 'java.util' END AS pkg FROM corpus),
entries AS (
  SELECT doc_id, text, source AS doc_set, CASE WHEN number < 6 THEN '21' WHEN number < 12 THEN '24' WHEN number < 18 THEN '25' ELSE '' END AS version,
    CASE WHEN {_count('e', 4)} <> 0 THEN 'official' ELSE 'community' END AS source_kind, CASE WHEN {_count('i', 3)} <> 0 THEN 'api-docs' ELSE 'guide' END AS doc_type,
    'name' || length(text) % 2 AS source_name, ['docs', 'pdfs', 'docs', 'books'][1 + {_count('n', 4)}] AS collection, kind, pkg AS package,
    ['of', 'entry', 'get'][1 + {_count('e', 3)}] AS method, ['(E,E)', '()', '(K,V)'][1 + {_count('a', 3)}] AS sig, sha256(text) AS hash
  FROM e0),
platform AS (SELECT kind, method, list(DISTINCT package) AS packages FROM entries WHERE doc_type = 'api-docs' GROUP BY ALL),
b AS (
  SELECT item_id AS query, text AS t, length(text) % 6 AS n, ['List', 'Map', 'Set'][1 + {_count('t', 3)}] AS kind, ['of', 'entry', 'get'][1 + {_count('h', 3)}] AS method,
    CASE WHEN length(text) % 6 = 2 THEN ['(E,E)', '()', '(K,V)'][1 + {_count('s', 3)}] END AS sig,
    CASE length(text) % 6 WHEN 0 THEN ['21', '25'] WHEN 1 THEN ['24'] WHEN 2 THEN ['21'] WHEN 4 THEN ['24', '21'] ELSE [] END AS parsed,
    CASE WHEN {_count('i', 7)} = 0 THEN ['21', '25'] ELSE [] END AS versions,
    CASE WHEN {_count('a', 3)} = 0 OR length(text) % 6 IN (2, 3) THEN ['src0', 'src1', 'src6', 'src12', 'src13'] WHEN {_count('a', 3)} = 1 THEN list_transform(range(18), lambda i: 'src' || i) ELSE [] END AS sets,
    CASE WHEN {_count('e', 2)} = 0 THEN 'official' ELSE '' END AS source_kind, CASE WHEN {_count('o', 5)} = 0 THEN 'api-docs' ELSE '' END AS doc_type, CASE WHEN {_count('r', 9)} = 0 THEN 'name1' ELSE '' END AS source_name
  FROM benchmark),
-- The platform resolves a member: by the package that is written, or the only one.
m AS (SELECT b.*, CASE WHEN n = 2 AND list_contains(packages, 'java.util') THEN 'java.util' WHEN n = 3 AND len(packages) = 1 THEN packages[1] END AS package FROM b LEFT JOIN platform p ON n IN (2, 3) AND p.kind = b.kind AND p.method = b.method),
-- Every question with sets has all three sets of releases; its official ones without a release lose two.
s AS (
  SELECT *, package IS NOT NULL AND len(sets) > 0 AS by_member, CASE WHEN len(sets) > 0 AND source_kind = 'official' AND parsed = [] AND versions = [] AND NOT (package IS NOT NULL AND sig IS NOT NULL) THEN list_filter(sets, lambda x: x NOT IN ('src0', 'src6')) ELSE sets END AS doc_sets,
    t || CASE n WHEN 0 THEN ' in Java 21 and 25?' WHEN 2 THEN ' What does java.util.' || kind || '.' || method || replace(sig, ',', ', ') || ' do in Java 21?' WHEN 3 THEN ' How is ' || kind || '.' || method || ' used?' WHEN 4 THEN ' ' || kind || '.' || method || ' or Deque.peek, vs Java 24 + 21' ELSE '' END AS said
  FROM m),
asked AS (
  SELECT *, CASE WHEN n = 1 THEN 'JDK 24: ' || said ELSE said END AS question, len(parsed) > 0 AND len(versions) > 0 AND len(list_intersect(parsed, versions)) < len(parsed) AS conflict FROM s)
"""
#: {path}: whether a question is answered from a member's own entries.
SCOPES_SQL = """
scopes AS (
  SELECT query, unnest(CASE WHEN parsed = [] THEN [0] ELSE range(len(parsed)) END) AS scope, parsed, versions, doc_sets, source_kind, doc_type, source_name, {path} AS by_member, {path} AND package IS NOT NULL AND sig IS NOT NULL AS exact, package, kind, method, sig
  FROM asked WHERE NOT conflict),
inside AS (
  SELECT s.query, CAST(s.scope AS INTEGER) AS scope, e.doc_id, s.by_member, s.exact
  FROM scopes s JOIN entries e ON
    (CASE WHEN s.parsed = [] THEN s.versions = [] OR list_contains(s.versions, e.version) ELSE e.version = s.parsed[1 + s.scope] END)
    AND (s.doc_sets = [] OR list_contains(s.doc_sets, e.doc_set)) AND s.source_kind IN ('', e.source_kind) AND s.doc_type IN ('', e.doc_type) AND s.source_name IN ('', e.source_name)
    AND CASE WHEN s.exact THEN e.collection = 'docs' WHEN s.by_member THEN e.collection IN ('docs', 'pdfs') ELSE true END
    AND CASE WHEN s.by_member AND s.package IS NOT NULL THEN e.kind = s.kind AND e.package = s.package ELSE true END
    AND CASE WHEN s.exact THEN e.method = s.method AND e.sig = s.sig ELSE true END)
"""
#: Scores of {search} by shared terms.
WORDS_SQL = (
    TERMS.replace("SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark", "SELECT query AS item_id, unnest(regexp_extract_all(lower({search}), '[\\p{L}\\p{N}]+')) AS term FROM asked")
    .replace("{L}", "{{L}}")
    .replace("{N}", "{{N}}")
)
BOOSTED = "CASE WHEN by_member THEN kind || ' ' || method ELSE CASE WHEN parsed = [] THEN '' ELSE array_to_string(list_transform(parsed, lambda v: 'JDK ' || v || ' Java SE ' || v || ' Java ' || v || ' release documentation'), '; ') || ': ' END || question END"
#: A list of (doc_id, version) is covered release by release, in at most {limit} rows; {order} is the candidates' order.
COVER_SQL = """
listed AS (SELECT query, list({{'d': doc_id, 'v': version, 's': score}} ORDER BY place) AS found FROM ordered GROUP BY query),
judged AS (
  SELECT a.query, a.parsed, coalesce(l.found, []) AS found, CASE WHEN conflict THEN 'Conflicting document version constraints'
    WHEN {member} AND l.found IS NULL THEN 'No official Java API evidence found for the requested member'
    ELSE 'No official documentation evidence found for requested Java release ' || list_filter(parsed, lambda v: NOT list_contains(list_transform(coalesce(l.found, []), lambda r: r.v), v))[1] END AS failure
  FROM asked a LEFT JOIN listed l USING (query)),
cover AS (
  SELECT query, 0 AS i, parsed, found, found[1:{limit}] AS kept FROM judged WHERE failure IS NULL
  UNION ALL
  SELECT query, i + 1, parsed, found, CASE WHEN len(list_filter(kept, lambda r: r.v = parsed[i + 1])) > 0 THEN kept WHEN len(kept) < {limit} THEN kept || [new] ELSE kept[1:spare - 1] || [new] || kept[spare + 1:] END
  FROM (
    SELECT *, list_filter(found, lambda r: r.v = parsed[i + 1])[1] AS new,
      list_max(list_filter(range(1, len(kept) + 1), lambda j: NOT list_contains(parsed, kept[j].v) OR len(list_filter(kept, lambda r: r.v = kept[j].v)) > 1)) AS spare
    FROM cover WHERE i < len(parsed))),
final AS (SELECT query, unnest(kept) AS r, unnest(range(1, len(kept) + 1)) AS place FROM cover WHERE i = len(parsed)),
said AS (SELECT j.query, j.failure, CAST(f.place AS INTEGER) AS place, f.r.d AS doc_id, f.r.v AS version, f.r.s AS score FROM judged j LEFT JOIN final f USING (query))
"""

SQL = {
    "h25_i9_asked": f"""WITH {ENTRIES_SQL} SELECT query, sha256(question) AS question_hash, array_to_string(parsed, ',') AS requested, CASE WHEN n IN (2, 3, 4) THEN kind || '.' || method END AS first_member, package, CASE WHEN package IS NOT NULL THEN sig END AS signature,
        CASE WHEN by_member THEN 'member' ELSE 'hybrid' END AS path, conflict, sha256({BOOSTED}) AS search_hash, array_to_string(doc_sets, ',') AS doc_sets FROM asked""",
    "i6_question_scopes": f"WITH {ENTRIES_SQL}, {SCOPES_SQL.format(path='by_member')} SELECT query, scope, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids, min(doc_id) AS first, max(doc_id) AS last FROM inside GROUP BY 1, 2",
    "i6_i10_retrieval": f"""WITH RECURSIVE {ENTRIES_SQL}, {SCOPES_SQL.format(path='by_member')}, {WORDS_SQL.format(search=BOOSTED)},
words AS (SELECT i.query, i.scope, i.doc_id, i.by_member, s.score, row_number() OVER (PARTITION BY i.query, i.scope ORDER BY s.score DESC, i.doc_id) AS rank FROM inside i JOIN scores s ON s.item_id = i.query AND s.doc_id = i.doc_id WHERE NOT exact),
sims AS (
  SELECT i.query, i.scope, i.doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM inside i JOIN embeddings q ON q.vec_id = 20 * i.query JOIN embeddings d ON d.vec_id = i.doc_id WHERE NOT by_member),
near AS (SELECT *, row_number() OVER (PARTITION BY query, scope ORDER BY score DESC, doc_id) AS rank FROM sims),
fused AS (SELECT query, scope, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, scope, doc_id, rank FROM words WHERE NOT by_member AND rank <= {PREFETCH} UNION ALL SELECT query, scope, doc_id, rank FROM near WHERE rank <= {PREFETCH}) GROUP BY 1, 2, 3),
found AS (
  SELECT query, scope, doc_id, score, rank, true AS m FROM words WHERE by_member AND rank <= {TOP_K}
  UNION ALL SELECT * FROM (SELECT query, scope, doc_id, score, row_number() OVER (PARTITION BY query, scope ORDER BY score DESC, doc_id) AS rank, false FROM fused) WHERE rank <= {TOP_K}
  UNION ALL SELECT * FROM (SELECT query, scope, doc_id, 1.0::DOUBLE, row_number() OVER (PARTITION BY query, scope ORDER BY doc_id) AS rank, true FROM inside WHERE exact) WHERE rank <= {TOP_K}),
own AS (
  SELECT f.*, e.version, e.hash FROM found f JOIN entries e USING (doc_id) JOIN asked a USING (query)
  WHERE NOT m OR (e.doc_type = 'api-docs' AND e.method = a.method AND (a.sig IS NULL OR a.sig = e.sig))),
seen AS (SELECT *, row_number() OVER (PARTITION BY query, version, hash ORDER BY scope, rank) AS n FROM own),
ordered AS (SELECT query, doc_id, version, score, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN m THEN 0 ELSE -score END, scope, rank) AS place FROM seen WHERE n = 1),
{COVER_SQL.format(member='by_member', limit=RETURN_K)}
SELECT query, failure, place, said.doc_id, version, score, sha256(CASE WHEN length(text) <= 400 THEN text ELSE CASE WHEN stop > 320 THEN left(text, stop + 1) ELSE left(text, 400) END || chr(10) || '[...content truncated for token limits...]' END) AS text_hash, length(text) > 400 AS truncated
FROM said LEFT JOIN (SELECT doc_id, text, greatest(399 - coalesce(nullif(instr(reverse(left(text, 400)), '.'), 0), 401) + 1, 399 - coalesce(nullif(instr(reverse(left(text, 400)), chr(10)), 0), 401) + 1) AS stop FROM documents) d ON d.doc_id = said.doc_id""",
    "e4_i9_citation_order": f"""WITH RECURSIVE {ENTRIES_SQL}, {SCOPES_SQL.format(path='true')}, {WORDS_SQL.format(search="CASE WHEN package IS NOT NULL THEN kind || ' ' || method WHEN n IN (2, 3, 4) THEN question || ' ' || kind || ' ' || method ELSE question END")},
found AS (
  SELECT * FROM (SELECT i.query, i.scope, i.doc_id, s.score, row_number() OVER (PARTITION BY i.query, i.scope ORDER BY s.score DESC, i.doc_id) AS rank FROM inside i JOIN scores s ON s.item_id = i.query AND s.doc_id = i.doc_id WHERE NOT exact) WHERE rank <= {TOP_K}
  UNION ALL SELECT * FROM (SELECT query, scope, doc_id, 1.0::DOUBLE, row_number() OVER (PARTITION BY query, scope ORDER BY doc_id) AS rank FROM inside WHERE exact) WHERE rank <= {TOP_K}),
own AS (
  SELECT f.*, e.version, e.hash, len(a.parsed) AS fanned,
    CASE WHEN a.n NOT IN (2, 3, 4) OR (a.package IS NOT NULL AND a.sig IS NOT NULL) THEN 0 WHEN e.doc_type <> 'api-docs' THEN 3
      WHEN e.kind = a.kind AND (a.n <> 2 OR e.package = 'java.util') THEN CASE WHEN declared THEN 0 ELSE 1 END WHEN declared THEN 2 ELSE 3 END AS tier
  FROM found f JOIN (SELECT *, {_count('u', 2)} = 0 AS talks FROM entries) e USING (doc_id) JOIN asked a USING (query),
    LATERAL (SELECT (talks AND e.method = a.method) AS declared)
  WHERE a.package IS NULL OR (e.doc_type = 'api-docs' AND e.method = a.method AND (a.sig IS NULL OR a.sig = e.sig))),
seen AS (SELECT *, CASE WHEN fanned > 0 THEN row_number() OVER (PARTITION BY query, version, hash ORDER BY scope, rank) ELSE 1 END AS n FROM own),
ordered AS (SELECT query, doc_id, version, score, row_number() OVER (PARTITION BY query ORDER BY tier, scope, rank) AS place FROM seen WHERE n = 1),
{COVER_SQL.format(member='false', limit=CITATIONS)}
SELECT query, failure, place, doc_id, version FROM said""",
}

QUERIES = {name: globals()[name] for name in SQL}
