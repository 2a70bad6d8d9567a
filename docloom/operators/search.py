"""Search under constraints: scopes and releases, citations, exact overloads, and what becomes of the rows that are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import cut_with_ellipsis
from docloom.functions.urls import canonical_doc_url, citation_identity, without_fragment
from docloom.operators.registry import REDACTED, document_urls
from docloom.operators.sparse import document_scores, top_k
from docloom.plans.constraints import Constraint
from docloom.plans.query_parse import unique_member

# Fixed value: the hash of no documents.
EMPTY = "empty"


def fan_out(constraint: Constraint, versions: list[str]) -> dict[str, Constraint]:
    """The constraint narrowed to each requested version, by version; without versions itself, by the empty name."""
    return {v: constraint.with_doc_versions([v]) for v in versions} if versions else {"": constraint}


def search_scopes(scored: DataFrame, scopes: dict[str, Constraint], query: str, key: str, k: int, **columns: str) -> DataFrame:
    """(query, scope, key, score, rank): each scope's own k best rows of each query.

    scored is read once, whatever the number of scopes; a row counts in every scope that it is in. columns: names of the payload columns.
    """
    inside = F.filter(F.array(*(F.when(c.condition(**columns), F.lit(name)) for name, c in scopes.items())), lambda s: s.isNotNull())
    placed = scored.select(query, key, "score", F.explode(inside).alias("scope"))
    return top_k(placed, [query, "scope"], key, k)


def search_documents(documents: DataFrame, queries: DataFrame, weights: DataFrame, scopes: dict[str, Constraint], query: str, key: str, k: int, **columns: str) -> DataFrame:
    """search_scopes of the scores of documents (key, terms, counts and the payload columns, as of sparse.documents_of_terms): documents are scored and cut where they lie.

    Documents of the same scopes are one group, whose k best of each task are enough for each of its scopes.
    """
    flags = F.concat(*(F.when(F.coalesce(c.condition(**columns), F.lit(False)), "1").otherwise("0") for c in scopes.values()))
    within = documents.withColumn("__in", flags).where(F.contains("__in", F.lit("1")))
    found = document_scores(within, queries, weights, query, key, k, ["__in"])
    names = F.filter(F.array(*(F.when(F.substring("__in", i, 1) == "1", F.lit(name)) for i, name in enumerate(scopes, 1))), lambda s: s.isNotNull())
    return top_k(found.select(query, F.explode(names).alias("scope"), key, "score"), [query, "scope"], key, k)


def require_versions(found: DataFrame, query: str, versions: list[str]) -> DataFrame:
    """found, if every query has rows of every version; else an error names one that is missing."""
    wanted = found.select(query).distinct().select(query, F.explode(F.array(*map(F.lit, versions))).alias("scope"))
    missing = wanted.join(found.select(query, "scope").distinct(), [query, "scope"], "left_anti").first()
    if missing is not None:
        raise LookupError(f"no evidence for release {missing['scope']} in query {missing[query]}")
    return found


def requires_member_evidence(question: str | None, constraint: Constraint, api_sets: set[str]) -> bool:
    """Whether a question must be answered from a member's own page: it names one member, and API pages are in scope."""
    return unique_member(question) is not None and bool(api_sets & set(constraint.doc_sets))


def citation_condition(question: str, constraint: Constraint, type_page: str = "type_page", package: str = "package", anchor: str = "anchor", **columns: str) -> Column:
    """The constraint, and for a question that names one member its type's page, its package if known, and its overload's anchor if exact."""
    out, member = constraint.condition(**columns), unique_member(question)
    if member is not None:
        out = out & (F.col(type_page) == f"{member.type}.html")
        if member.package:
            out = out & (F.col(package) == member.package)
        if member.signature is not None:
            out = out & (F.col(anchor) == f"{member.method}{member.signature}")
    return out


def exact_overload(points: DataFrame, condition: Column, key: str, k: int) -> DataFrame:
    """The first k points in order that the condition alone selects, all of score 1."""
    return points.where(condition).orderBy(key).limit(k).withColumn("score", F.lit(1.0))


def platform_package(members: DataFrame, platform: DataFrame) -> DataFrame:
    """members (type, method) with package: that of the only package of platform (package, type, method) that declares it, else null."""
    one = platform.groupBy("type", "method").agg(F.min("package").alias("package"), F.count_distinct("package").alias("n")).where("n = 1").drop("n")
    return members.join(one, ["type", "method"], "left")


def retained(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def payload_rows(points: DataFrame, strings: list[str], integers: list[str]) -> DataFrame:
    """points with blank strings as null and integers within 32 bits, cut at its ends; other columns as they are."""
    clamp = lambda c: F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), F.col(c))).cast("int")
    filled = {c: F.when(~F.col(c).rlike(r"^\s*$"), F.col(c)) for c in strings}
    return points.withColumns(filled | {c: clamp(c) for c in integers})


def citations(rows: DataFrame, by: list[str], order: str, sources: DataFrame, hosts: list[str] | None = None, snippet: int = 500, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables. (by, order, url, title, anchor, snippet): a citation for the first row of each identity; (by, failed): rows that could not be converted, where there are any.

    URLs are those of registry.document_urls: of web addresses the canonical form, of local files their source's page, and of files that no source claims a
    redaction, whose raw path is then the identity. A row's own anchor takes the place of the URL's fragment. Rows without a URL are all kept.
    Snippets are cut with an ellipsis. failed: rows that no citation can be made of, such as those without what they must have; they are counted,
    never silently left out. First rows are found by their place alone; texts are not aggregated. by and order: together a key of rows (url, title, anchor, text).
    """
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    failures = rows.where(bad).groupBy(*by).agg(F.count(F.lit(1)).alias("failed"))
    shown = document_urls(rows.where(~bad).select(*by, order, "url", "title", "anchor", "text"), "url", sources, hosts)
    shown = shown.withColumn("__normal", F.coalesce("public_url", F.lit(""))).withColumn("__page", without_fragment(F.col("__normal")))
    web = F.col("__page").startswith("http://") | F.col("__page").startswith("https://")
    own, page = F.coalesce("anchor", F.lit("")), F.when(web, canonical_doc_url(F.col("__page"))).otherwise(F.col("__page"))
    shown = shown.withColumn("refined", F.when(F.trim(own) != "", F.concat(page, F.lit("#"), own)).otherwise(F.col("__normal")))
    raw = F.trim(F.coalesce("url", F.lit("")))
    unknown = raw.startswith("file://") & (F.col("__normal") == REDACTED)
    judged = shown.select(*by, order, "refined", F.when(unknown, without_fragment(raw)).otherwise(F.col("refined")).alias("identity"), "title", cut_with_ellipsis(F.coalesce("text", F.lit("")), snippet).alias("snippet"))
    # A row without an identity is its own.
    key = F.when(F.trim("identity") == "", F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col("identity"))
    first = judged.groupBy(*(F.col(c).alias(f"__{c}") for c in by), key.alias("__key")).agg(F.min(order).alias("__order")).drop("__key")
    at = F.locate("#", F.col("refined"))
    anchor = F.when(at > 0, F.substring(F.col("refined"), at + 1, F.length("refined"))).otherwise("")
    same = judged[order].eqNullSafe(first["__order"])
    for c in by:
        same = same & judged[c].eqNullSafe(first[f"__{c}"])
    found = judged.join(first, same, "left_semi")
    return found.select(*by, order, without_fragment(F.col("refined")).alias("url"), "title", anchor.alias("anchor"), "snippet"), failures


def documents_hash(docs: DataFrame, by: str, order: str, parts: list[Column], of: DataFrame | None = None) -> DataFrame:
    """(by, hash): SHA-256 over the parts of a top-k's documents in order, each after its length in four bytes, so that no two lists share a text.

    of: a table with all values of by; those without a document have the hash `empty`.
    """
    sized = lambda p: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "UTF-8"))
    one = F.concat(*(sized(F.coalesce(p, F.lit(""))) for p in parts))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.hex(one).alias("bytes"))))
    found = docs.groupBy(by).agg(F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["bytes"]), "")), 256).alias("hash"))
    return found if of is None else of.select(by).distinct().join(found, by, "left").select(by, F.coalesce("hash", F.lit(EMPTY)).alias("hash"))


def in_sequence(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with seq, their part's number; sorted by it and their own order they follow one another as one stream."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_citations(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows (by, order, url, anchor) without those whose URL is null, and of each place that a list leads to the first only. by and order are a key of rows."""
    named = rows.where(F.col("url").isNotNull()).withColumn("__identity", citation_identity(F.col("url"), F.col("anchor")))
    first = named.groupBy(*(F.col(c).alias(f"__{c}") for c in by), F.col("__identity").alias("__of")).agg(F.min(order).alias("__order"))
    same = (named["__identity"] == first["__of"]) & (named[order] == first["__order"])
    for c in by:
        same = same & named[c].eqNullSafe(first[f"__{c}"])
    return named.join(first, same, "left_semi").drop("__identity")
