"""Answers and failures of services, notes on searches, lessons, and copies of rejected files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import faults, lessons, quality, runs, vectors
from docloom.sources import mirrors
from docloom.tables import read

BATCH, RESPONSE, DIMENSION = 32, 16, 64
MESSAGES = ["HTTP 404 for {}", "{} Not Found", "401", "Unauthorized {}", "forbidden: {}", "Too Many Requests ({})", "Connection reset by {}", "Embedding provider {} is down", "embedding of {} failed", "{} unreachable", "Embedding service {} UNAVAILABLE", "status 429 and 403"]
STATUS = ["ABORTED", "DEADLINE_EXCEEDED", "INTERNAL", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "NOT_FOUND"]
CORE, WEAK = "Answer from the documents.", "Say what is not certain."
API_SETS = {"21": "java/java21-api", "25": "java/java25-api"}


def picked(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def h56_vector_faults(spark, sf_dir):
    """Batches of 32 vectors, of which some are null or cut, and some batches lack one."""
    e, i = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    batch = F.floor(i / BATCH).alias("batch")
    vector = F.when(i % 97 == 5, F.lit(None)).when(i % 89 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    batches = e.groupBy(batch).agg((F.count(F.lit(1)) + F.when(F.first(batch) % 13 == 4, 1).otherwise(0)).alias("expected"))
    return vectors.vector_faults(batches, e.select(batch, (i % BATCH).alias("position"), vector.alias("vector")), DIMENSION)


def h57_declared_order(spark, sf_dir):
    """Answers of 16 vectors: without indexes, backwards, with a repeated one, from 1, and with an empty vector; some lack one."""
    e, i = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    r, n = F.floor(i / RESPONSE), i % RESPONSE
    index = F.when(r % 5 == 1, RESPONSE - 1 - n).when((r % 5 == 2) & (n == 7), 8).when(r % 5 == 3, n + 1).when(r % 5 != 0, n)
    vector = F.when((r % 10 == 4) & (n == 5), F.array().cast("array<bigint>")).otherwise(F.array("vec_id"))
    entries = e.select(r.alias("response"), n.alias("entry"), index.alias("index"), vector.alias("vector"))
    responses = entries.groupBy("response").agg((F.count(F.lit(1)) + F.when(F.first("response") % 7 == 6, 1).otherwise(0)).alias("expected"))
    found = vectors.declared_order(responses, entries)
    return found.select("response", "fault", "at", F.array_join(F.transform("vectors", lambda v: v[0].cast("string")), ",").alias("vectors"))


def h62_error_categories(spark, sf_dir):
    i = F.col("doc_id")
    message = F.when(i % 17 != 0, F.replace(picked(MESSAGES, i), F.lit("{}"), F.coalesce("source", F.lit("x"))))
    status, timed_out = F.when(i % 5 == 0, picked(STATUS, i / 5)), i % 11 == 0
    category = faults.error_category(status, message, timed_out)
    return read(spark, sf_dir, "documents").select("doc_id", category.alias("category"), faults.is_retryable(category).alias("retryable"), faults.disposition(status, timed_out).alias("disposition"))


def i14_noted_prompts(spark, sf_dir):
    """Five documents a question; for some they come from keyword search."""
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("question"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.when(F.col("doc_id") % 31 == 0, "https://local-search/").otherwise("https://docs/"), F.coalesce("source", F.lit(""))).alias("url"))
    levels = quality.search_quality(d, "question")
    note = faults.search_note(F.col("level"), F.col("results"), F.col("high"))
    return levels.select("question", faults.noted_prompt(F.lit(CORE), note, F.lit(WEAK)).alias("prompt"))


def i17_lessons(spark, sf_dir):
    """A lesson a document: its source is its technology (every second one is of java), its language the summary."""
    i = F.col("doc_id")
    technology = F.when(i % 2 == 0, "java").when(i % 3 == 0, " ").otherwise(F.coalesce("source", F.lit("")))
    asked = F.when(i % 8 == 0, F.array(F.lit("25"), F.lit("21"))).when(i % 8 < 4, F.array(F.lit("21"))).otherwise(F.array().cast("array<string>"))
    keywords = F.when(i % 7 == 0, F.lit(None)).otherwise(F.array(F.lit("streams"), F.coalesce("lang", F.lit("any"))))
    rows = read(spark, sf_dir, "documents").select("doc_id", technology.alias("technology"), F.col("source").alias("title"), F.col("lang").alias("summary"), keywords.alias("keywords"), F.array(F.concat(F.lit("set/"), F.coalesce("source", F.lit("")))).alias("doc_sets"), asked.alias("versions"))
    scoped = lessons.lesson_scopes(rows, API_SETS, "java")
    return scoped.select("doc_id", lessons.lesson_query(F.col("technology"), F.col("title"), F.col("summary"), F.col("keywords")).alias("query"), F.array_join("doc_sets", ",").alias("doc_sets"))


def f11_snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("lesson"), "doc_id", F.length("text").alias("rank_by"))
    return lessons.snippets(d.withColumn("order", F.struct("rank_by", "doc_id")), "lesson", "order").select("lesson", "doc_id", "place")


def a25_quarantine(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/other/"), i, F.lit(".html"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/w/docs/a/plain"), i))
    path = path.when(F.col("page_id") % 5 == 2, F.lit("/w/docs/b/.hidden")).otherwise(F.concat(F.lit("/w/docs/en/x.y/"), i, F.lit(".tar.gz")))
    copies = lessons.quarantine(read(spark, sf_dir, "pages").select(path.alias("path"), F.coalesce("html", F.lit("")).alias("content")), "/w/docs")
    return copies.select("inspection_path", "fingerprint", "files", F.length("content").alias("characters"))


def h43_published_identities(spark, sf_dir):
    """Mirrors of 25 pages, which declare a version, another one on one page, or none, and show the release or hold it in a script."""
    m, n = F.floor(F.col("page_id") / 25), F.col("page_id") % 25
    version = F.when(m % 4 == 0, "25").when((m % 4 == 1) & (n == 3), "26").when(m % 4 == 1, "25").when(m % 4 == 3, " 25 ")
    meta = F.coalesce(F.concat(F.lit('<META NAME="Version" content="'), version, F.lit('">')), F.lit(""))
    shown = F.when(m % 3 == 0, "<script>Release 25</script>").otherwise("<p>Release\n<b>25</b></p>")
    pages = read(spark, sf_dir, "pages").select(m.alias("mirror"), F.concat(meta, shown, F.coalesce("html", F.lit(""))).alias("html"), (n == 1).alias("required"))
    return mirrors.published_identities(pages, "mirror", "html", "required", "25", "Release 25")


def _runs(spark, sf_dir):
    """Runs of the directories that users are, from their events: how far each came, when it was seen last, and the same directories as they are claimed."""
    e, at = read(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = {"processed": "click", "skipped": "view", "failed": "error"}
    g = e.where("user_id IS NOT NULL").groupBy(F.col("user_id").cast("string").alias("directory")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("seen"), F.sum("event_id").alias("s"), *(F.count_if(F.col("event_type") == t).alias(k) for k, t in kinds.items()))
    at_rest = F.when(F.col("s") % 5 == 0, "COMPLETE").when(F.col("s") % 5 == 1, "PARTIAL").otherwise("RUNNING")
    name = F.concat(F.lit("f"), F.col("n").cast("string"))
    old = g.where("s % 7 <> 0").select("directory", name.alias("fingerprint"), at_rest.alias("lifecycle"), F.col("n").alias("eligible"), "processed", "skipped", "failed", F.least(F.col("n") - F.col("processed") - F.col("skipped") - F.col("failed"), F.lit(2)).alias("in_progress"), F.concat(F.lit("o"), (F.col("s") % 3).cast("string")).alias("owner"), "seen")
    wanted = g.select("directory", F.when(F.col("s") % 11 == 0, F.lit("other")).otherwise(name).alias("fingerprint"), (F.col("n") + F.when(F.col("s") % 13 == 0, 1).otherwise(0)).alias("eligible"), F.lit("o1").alias("owner"))
    return old, wanted, F.lit(e.agg(F.max(at)).first()[0])


LEASE = 86_400_000_000
RUNS = """x AS (SELECT user_id::VARCHAR AS directory, count(*) AS n, max(epoch_us(ts)) AS seen, sum(event_id)::BIGINT AS s, count_if(event_type = 'click')::BIGINT AS processed, count_if(event_type = 'view')::BIGINT AS skipped, count_if(event_type = 'error')::BIGINT AS failed, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events WHERE user_id IS NOT NULL GROUP BY 1),
    old AS (SELECT directory, 'f' || n AS fingerprint, CASE s % 5 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' ELSE 'RUNNING' END AS lifecycle, n AS eligible, processed, skipped, failed, least(n - processed - skipped - failed, 2) AS in_progress, 'o' || s % 3 AS owner, seen, now FROM x WHERE s % 7 <> 0),
    wanted AS (SELECT directory, CASE WHEN s % 11 = 0 THEN 'other' ELSE 'f' || n END AS fingerprint, n + CASE WHEN s % 13 = 0 THEN 1 ELSE 0 END AS eligible, 'o1' AS owner, now FROM x)"""


def a24_reconciled_runs(spark, sf_dir):
    old, _, now = _runs(spark, sf_dir)
    return runs.reconciled(old, now, LEASE)


def a24_j12_claims(spark, sf_dir):
    old, wanted, now = _runs(spark, sf_dir)
    return runs.claimed(old, wanted, now, LEASE)


def j12_until_first_failure(spark, sf_dir):
    """Each user's events as outcomes of a run, in their order."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return runs.until_first_failure(e, "user_id", "event_id", "failed")


QUERIES = {
    "h43_published_identities": h43_published_identities,
    "h56_vector_faults": h56_vector_faults,
    "h57_declared_order": h57_declared_order,
    "h62_error_categories": h62_error_categories,
    "i14_noted_prompts": i14_noted_prompts,
    "i17_lessons": i17_lessons,
    "f11_snippets": f11_snippets,
    "a25_quarantine": a25_quarantine,
    "a24_reconciled_runs": a24_reconciled_runs,
    "a24_j12_claims": a24_j12_claims,
    "j12_until_first_failure": j12_until_first_failure,
}
SQL = {
    "a24_reconciled_runs": f"""WITH {RUNS}, d AS (SELECT *, lifecycle = 'RUNNING' AND seen <= now - {86_400_000_000} AS dead FROM old)
        SELECT directory, fingerprint, CASE WHEN dead THEN 'PARTIAL' ELSE lifecycle END AS lifecycle, eligible, processed, skipped, CASE WHEN dead THEN 0 ELSE failed END AS failed, CASE WHEN dead THEN 0 ELSE in_progress END AS in_progress, owner, seen,
        processed + skipped + CASE WHEN dead THEN 0 ELSE failed END AS inspected, eligible - processed - skipped - CASE WHEN dead THEN 0 ELSE failed + in_progress END AS pending FROM d""",
    "a24_j12_claims": f"""WITH {RUNS}, j AS (SELECT w.directory, w.fingerprint AS f, w.eligible AS e, w.owner AS o, w.now AS t, old.* EXCLUDE (directory, now),
        CASE WHEN old.lifecycle = 'RUNNING' AND old.seen > w.now - {86_400_000_000} AND old.owner <> w.owner THEN 'refused' WHEN old.fingerprint = w.fingerprint AND old.eligible = w.eligible AND old.lifecycle <> 'COMPLETE' THEN 'resumed' ELSE 'fresh' END AS claim FROM wanted w LEFT JOIN old USING (directory))
        SELECT directory, CASE claim WHEN 'refused' THEN fingerprint ELSE f END AS fingerprint, 'RUNNING' AS lifecycle, CASE claim WHEN 'refused' THEN eligible ELSE e END AS eligible, CASE claim WHEN 'fresh' THEN 0 ELSE processed END AS processed, CASE claim WHEN 'fresh' THEN 0 ELSE skipped END AS skipped,
        CASE claim WHEN 'refused' THEN failed ELSE 0 END AS failed, CASE claim WHEN 'refused' THEN in_progress ELSE 0 END AS in_progress, CASE claim WHEN 'refused' THEN owner ELSE o END AS owner, CASE claim WHEN 'refused' THEN seen ELSE t END AS seen, claim FROM j""",
    "j12_until_first_failure": "SELECT user_id, event_id, event_type = 'error' AS failed FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id IS NOT DISTINCT FROM e.user_id AND f.event_type = 'error' AND f.event_id < e.event_id)",
    "h43_published_identities": """WITH p AS (SELECT page_id // 25 AS mirror, page_id % 25 AS n FROM pages), v AS (SELECT *, CASE mirror % 4 WHEN 1 THEN CASE WHEN n = 3 THEN '26' ELSE '25' END WHEN 2 THEN NULL ELSE '25' END AS version FROM p)
        SELECT mirror, min(version) AS least_version, max(version) AS most_version, coalesce(min(version) = '25' AND max(version) = '25', false) AS version_agrees, bool_or(n = 1 AND mirror % 3 <> 0) AS text_found FROM v GROUP BY mirror""",
    "h56_vector_faults": """WITH v AS (SELECT vec_id // 32 AS batch, vec_id % 32 AS position, CASE WHEN vec_id % 97 = 5 THEN NULL WHEN vec_id % 89 = 3 THEN 10 ELSE len(embedding) END AS length FROM embeddings),
        b AS (SELECT batch, count(*) AS received, count(*) + CASE WHEN batch % 13 = 4 THEN 1 ELSE 0 END AS expected, min(CASE WHEN length IS NULL OR length <> 64 THEN position END) AS first FROM v GROUP BY batch)
        SELECT b.batch, expected, received, CASE WHEN expected <> received THEN 'count' WHEN v.length IS NULL THEN 'null' ELSE 'dimension' END AS fault,
            CASE WHEN expected = received THEN position END AS position, CASE WHEN expected = received THEN v.length END AS length
        FROM b LEFT JOIN v ON v.batch = b.batch AND v.position = b.first WHERE expected <> received OR first IS NOT NULL""",
    "h57_declared_order": """WITH e AS (SELECT vec_id // 16 AS r, vec_id % 16 AS n, vec_id FROM embeddings),
        p AS (SELECT *, CASE WHEN r % 5 = 1 THEN 15 - n WHEN r % 5 = 2 AND n = 7 THEN 8 WHEN r % 5 = 3 THEN n + 1 ELSE n END AS place, count(*) OVER (PARTITION BY r) + CASE WHEN r % 7 = 6 THEN 1 ELSE 0 END AS expected FROM e),
        f AS (SELECT *, CASE WHEN place < 0 OR place >= expected THEN 'bounds' WHEN row_number() OVER (PARTITION BY r, place ORDER BY n) > 1 THEN 'duplicate' WHEN r % 10 = 4 AND n = 5 THEN 'empty' END AS fault FROM p),
        s AS (SELECT r, max(expected) AS expected, min(n) FILTER (fault IS NOT NULL) AS first, arg_min(fault, n) FILTER (fault IS NOT NULL) AS fault, list(place) AS places, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY place) AS vectors FROM f GROUP BY r),
        m AS (SELECT *, list_min([x for x in range(expected) if NOT list_contains(places, x)]) AS missing FROM s)
        SELECT r AS response, coalesce(fault, CASE WHEN missing IS NOT NULL THEN 'missing' END) AS fault, coalesce(first, missing) AS "at", CASE WHEN fault IS NULL AND missing IS NULL THEN vectors END AS vectors FROM m""",
    "h62_error_categories": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN lower(replace(({MESSAGES})[doc_id % {len(MESSAGES)} + 1], '{{}}', coalesce(source, 'x'))) ELSE '' END AS m,
            CASE WHEN doc_id % 5 = 0 THEN ({STATUS})[(doc_id // 5) % {len(STATUS)} + 1] END AS s, doc_id % 11 = 0 AS t FROM documents),
        c AS (SELECT *, CASE WHEN s IN ('DEADLINE_EXCEEDED', 'UNAVAILABLE') THEN 'Connection Error' WHEN s IS NOT NULL THEN 'Unknown Error'
            WHEN regexp_matches(m, '404|not found') THEN '404 Not Found' WHEN regexp_matches(m, '401|unauthorized') THEN '401 Unauthorized' WHEN regexp_matches(m, '403|forbidden') THEN '403 Forbidden'
            WHEN regexp_matches(m, '429|too many requests') THEN '429 Rate Limited' WHEN t OR contains(m, 'connection') THEN 'Connection Error'
            WHEN contains(m, 'embedding') AND regexp_matches(m, 'unavailable|unreachable|provider') THEN 'Embedding Service Unavailable' ELSE 'Unknown Error' END AS category FROM d)
        SELECT doc_id, category, category IN ('429 Rate Limited', 'Connection Error') AS retryable, CASE WHEN t OR coalesce(s <> 'NOT_FOUND', false) THEN 'TRANSIENT' ELSE 'PERMANENT' END AS disposition FROM c""",
    "i14_noted_prompts": f"""WITH q AS (SELECT doc_id // 5 AS question, count(*) AS n, count(*) FILTER (length(text) > 100) AS high, bool_or(doc_id % 31 = 0 OR contains(coalesce(source, ''), 'keyword')) AS k FROM documents GROUP BY 1)
        SELECT question, '{CORE}' || chr(10) || chr(10) || 'SEARCH CONTEXT: ' || CASE
            WHEN k THEN 'Found ' || n || ' documents via keyword search (embedding service unavailable). Results may be less semantically relevant.' || chr(10) || '{WEAK}'
            WHEN high = n THEN 'Found ' || n || ' high-quality relevant documents via semantic search.'
            ELSE 'Found ' || n || ' documents (' || high || ' high-quality) via search. Some results may be less relevant.' || chr(10) || '{WEAK}' END AS prompt FROM q""",
    "i17_lessons": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'java' WHEN doc_id % 3 = 0 THEN ' ' ELSE coalesce(source, '') END AS t, source, lang FROM documents)
        SELECT doc_id, trim(CASE WHEN trim(t) <> '' THEN t || '. ' ELSE '' END || coalesce(source || '. ', '') || coalesce(lang || ' ', '') || CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'streams, ' || coalesce(lang, 'any') END) AS query,
            CASE WHEN t = 'java' AND doc_id % 8 = 0 THEN 'java/java25-api,java/java21-api' WHEN t = 'java' AND doc_id % 8 < 4 THEN 'java/java21-api' ELSE 'set/' || coalesce(source, '') END AS doc_sets FROM d""",
    "f11_snippets": "SELECT * FROM (SELECT doc_id // 10 AS lesson, doc_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY length(text) NULLS FIRST, doc_id) AS place FROM documents) WHERE place <= 6",
    "a25_quarantine": """WITH p AS (SELECT page_id % 5 AS k, CAST(page_id AS VARCHAR) AS i, coalesce(html, '') AS c, sha256(coalesce(html, '')) AS f FROM pages),
        q AS (SELECT '.quarantine/' || CASE k WHEN 0 THEN i || '.' || f || '.html' WHEN 1 THEN 'a/plain' || i || '.' || f WHEN 2 THEN 'b/.hidden.' || f ELSE 'en/x.y/' || i || '.tar.' || f || '.gz' END AS inspection_path, f, c FROM p)
        SELECT inspection_path, f AS fingerprint, count(*) AS files, max(length(c)) AS characters FROM q GROUP BY 1, 2""",
}
