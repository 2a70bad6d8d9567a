"""The queries of this package by name, and DuckDB SQL for those that it can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, decontaminate, exact_dedup, fill_middle, language_id, line_dedup, lm_score, manifest, mixing, near_dedup, pii, token_count, url_filter
from .shared import ascii_lower, read

Query = Callable[[SparkSession, str], DataFrame]


def fold(doc_id: str = "doc_id") -> Column:
    """Documents are dealt into five folds by their id; a row without an id is in none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(-1))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold() == 1)
    model = lm_score.train(docs.where("NOT held_out"))
    return lm_score.score(docs, model).select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), words=4)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"), pii.fitted_judge(spark))
    counts = [F.size(F.filter("base", kind_is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", kind_is("secret"))).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


def kind_is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    marked = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")), "page_id").where("block IS NOT NULL")
    # Of very many token sets some would look like rules by chance, so the bound is strict.
    rules = url_filter.mine_rules(marked.select(url_filter.url_tokens(*url_filter.url_parts(F.col("url"))).alias("tokens"), "block"), hits=20, z=3.09)
    return url_filter.filter_urls(pages, rules)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs, language_id.learn_prototypes(docs.where(fold() != 0)))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    kinds = {c: chats.schema[c].dataType for c in ("conv_id", "turn")}
    own = spark.range(1).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    own = own.withColumn("turn", F.col("turn").cast(kinds["turn"]))
    back = chat_format.read_back(chat_format.format_chats(chats.unionByName(own)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    proofs = manifest.prove_rows(docs, found={"text": ascii_lower(docs["text"])}, where=fold() == 0)
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return proofs.select("doc_id", *(F.lower(F.hex(a)).alias(b) for a, b in names.items()), (F.col("folded") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, {LOWER} AS low FROM documents) WINDOW g AS (PARTITION BY low)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM w WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(words_left AS DOUBLE) * w <= 3 * CAST(source_size AS DOUBLE) * w_left AS fits FROM l),
c AS (
  SELECT source, source_size, w, words_left, w_left,
    bool_or(fits) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free,
    first(CASE WHEN fits THEN words_left END IGNORE NULLS) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wl,
    first(CASE WHEN fits THEN w_left END IGNORE NULLS) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ww
  FROM f),
t AS (SELECT source, source_size, CASE WHEN free THEN CAST(wl AS DOUBLE) * CAST(w AS DOUBLE) / CAST(ww AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
q AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN whole < 3 AND (upto <= rest OR (upto - tied <= rest AND tied < 2 * (rest - (upto - tied)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, i, g.k, item FROM g JOIN win ON g.k = win.k AND g.gram = win.gram),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""

#: The formatted length needs the template: 8 characters a mark, 3 marks and the role a turn, one more for each escaped control string.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(23 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
n AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM t),
s AS (
  SELECT *, array_to_string(list_slice(tokens, 1, a), '') AS p, array_to_string(list_slice(tokens, a + 1, b), '') AS m, array_to_string(list_slice(tokens, b + 1, n), '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-')) >= 3),
x AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keep_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r
"""

CRC32 = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _climb_sql(name: str, levels: int) -> str:
    """Supersteps over {name}_0 (tree, i, digest): runs of each level, and the nodes above them; the top of a tree passes through."""
    out = []
    for k in range(levels):
        out.append(f"{name}_runs_{k} AS (SELECT tree, i // 16 AS i, list(digest ORDER BY i) AS run, any_value(width) AS width FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS width FROM {name}_{k}) GROUP BY tree, i // 16)")
        out.append(f"{name}_{k + 1} AS (SELECT tree, i, CASE WHEN width = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}_runs_{k})")
    return ",\n".join(out)


def _path_sql(name: str, before: str, tree: str, place: str, levels: int) -> str:
    """Paths through {name}'s levels: folds the digest of each row and gathers the digests beside it."""
    out = []
    for k in range(levels):
        at, pos = f"({place} // {16**k})", f"({place} // {16**k} % 16)"
        left, right = f"array_to_string(run[1:{pos}], '')", f"array_to_string(run[{pos} + 2:], '')"
        last = before if k == 0 else f"{name}_path_{k - 1}"
        out.append(
            f"{name}_path_{k} AS (SELECT p.* EXCLUDE (beside, folded), beside || CASE WHEN width = 1 THEN '' ELSE {left} || {right} END AS beside, CASE WHEN width = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
            f"FROM {last} p JOIN {name}_runs_{k} r ON r.tree IS NOT DISTINCT FROM {tree} AND r.i = {at} // 16)"
        )
    return ",\n".join(out)


#: Supersteps of a source's tree and of the sources': 16 to their power are the most leaves.
LEVELS, SOURCE_LEVELS = 6, 4
OP13_SQL = f"""
WITH d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {CRC32} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n_0 AS (SELECT source AS tree, i, leaf AS digest FROM leaves),
{_climb_sql("n", LEVELS)},
subroots AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM n_{LEVELS}),
s_0 AS (SELECT 0 AS tree, place AS i, subroot AS digest FROM subroots),
{_climb_sql("s", SOURCE_LEVELS)},
start AS (SELECT l.doc_id, l.i AS own_place, l.source, l.leaf, b.subroot, b.place, '' AS beside, coalesce(l.other, l.leaf) AS folded FROM leaves l JOIN subroots b ON l.source IS NOT DISTINCT FROM b.source),
{_path_sql("n", "start", "p.source", "p.own_place", LEVELS)},
{_path_sql("s", f"n_path_{LEVELS - 1}", "0", "p.place", SOURCE_LEVELS)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM s_path_{SOURCE_LEVELS - 1}, s_{SOURCE_LEVELS}
"""

QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_token_count": op7_token_count,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_fill_middle": op11_fill_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_manifest": op13_manifest,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op9_decontaminate": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_manifest": OP13_SQL}
