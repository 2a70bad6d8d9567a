"""Retrieval for a table of questions in one plan: each has its own constraint, releases and member.

    asked = plan_questions(questions, platform, ...)       what each question asks for, and on which path
    scopes = question_scopes(asked, ...)                    one row per question and release: the fields that must hold
    found = candidates(asked, scopes, ...)                  each scope's best rows, one after the other
    answers(asked, found, limit)                            first seen, members' evidence, releases covered, failures named

A question that can't be answered has a failure, so one of them does not end a job over many; require_answers makes them errors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import truncated
from docloom.operators import fusion, sparse
from docloom.plans import questions as q
from docloom.plans.scopes import in_scopes
from docloom.tables import settled

#: What a scope can set. type_page, package and anchor come from a member that the question names.
FIELDS = ("version", "source_kind", "doc_type", "source_name", "doc_set", "collection", "type_page", "package", "anchor")
LISTS = {"doc_versions": "version", "doc_sets": "doc_set"}

# Kinds of sources and documents, where official documents are, and what is said when there is no evidence.
OFFICIAL, API_DOCS = "official", "api-docs"
OFFICIAL_COLLECTIONS, DOCUMENTATION = ["docs", "pdfs"], ["docs"]
NO_MEMBER = "No official Java API evidence found for the requested member"
NO_RELEASE = "No official documentation evidence found for requested Java release "
CONFLICT = "Conflicting document version constraints"
NO_ROOM = "Retrieval result limit cannot represent every requested Java release"


def plan_questions(questions: DataFrame, platform: DataFrame, api_sets: dict[str, str], query: str = "query", text: str = "text") -> DataFrame:
    """(query, text, requested, member, first_member, exact, path, search_text, failure, and the constraint's fields).

    questions: query, text, doc_versions and doc_sets (arrays), source_kind, doc_type, source_name (blank: any). platform: (package, type, method) of
    the platform's members. api_sets: the documentation set of each release.

    A question that names one member of the platform, in the scope of its documentation, is answered from that member's own entries (path
    member; exact with a signature), others by meaning and words (path hybrid). A type is resolved by the only package that declares it.
    Broad official questions without a release leave the sets of older releases out.
    """
    supported, sets = list(api_sets), list(api_sets.values())
    newest = api_sets[max(supported, key=int)]
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    asked = questions.select(F.col(query).alias("query"), F.col(text).alias("text"), *(listed(F.col(c)).alias(c) for c in LISTS), *(blank(F.col(c)).alias(c) for c in ("source_kind", "doc_type", "source_name")))
    asked = asked.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("parsed", q.requested_versions(F.col("text"), supported)).withColumn("members", q.members(F.col("text")))
    asked = asked.withColumn("named", F.when(F.size("members") == 1, F.get("members", 0)))
    packages = platform.groupBy("type", "method").agg(F.collect_set("package").alias("packages")).select(F.col("type").alias("p_type"), F.col("method").alias("p_method"), "packages")
    asked = asked.join(packages, (F.col("named.type") == F.col("p_type")) & (F.col("named.method") == F.col("p_method")), "left")
    own = F.when(F.col("named.package") != "", F.when(F.array_contains("packages", F.col("named.package")), F.col("named.package"))).when(F.size("packages") == 1, F.get("packages", 0))
    asked = asked.withColumn("resolved", own).withColumn("member", F.when(F.col("resolved").isNotNull(), F.struct(F.col("resolved").alias("package"), F.col("named.type").alias("type"), F.col("named.method").alias("method"), F.col("named.signature").alias("signature"))))
    in_api = F.exists("doc_sets", lambda s: s.isin(sets))
    exact = F.col("member.signature").isNotNull()
    broad = (F.col("source_kind") == OFFICIAL) & F.size(F.array_except(F.array(*map(F.lit, sets)), "doc_sets")).eqNullSafe(0)
    keeps_old = (F.size("parsed") > 0) | (F.size("doc_versions") > 0) | (exact & in_api)
    asked = asked.withColumn("doc_sets", F.when(broad & ~F.coalesce(keeps_old, F.lit(False)), F.filter("doc_sets", lambda s: ~s.isin(sets) | (s == newest))).otherwise(F.col("doc_sets")))
    of = F.create_map(*(F.lit(x) for pair in api_sets.items() for x in pair))
    applicable = F.when(F.size("doc_sets") == 0, F.col("parsed")).otherwise(F.filter("parsed", lambda v: F.coalesce(F.array_contains("doc_sets", F.element_at(of, v)), F.lit(False))))
    asked = asked.withColumn("requested", applicable)
    allowed = F.filter("requested", lambda v: F.array_contains("doc_versions", v))
    versions = F.when(F.size("requested") == 0, F.col("doc_versions")).when(F.size("doc_versions") == 0, F.col("requested")).otherwise(allowed)
    conflict = (F.size("requested") > 0) & (F.size("doc_versions") > 0) & (F.size(F.array_intersect("requested", "doc_versions")) < F.size("requested"))
    by_member = F.col("member").isNotNull() & in_api
    words = F.concat_ws(" ", F.replace("member.type", F.lit("."), F.lit(" ")), "member.method")
    return asked.select(
        "query",
        "text",
        "requested",
        "member",
        F.get("members", 0).alias("first_member"),
        (by_member & F.coalesce(exact, F.lit(False))).alias("exact"),
        F.when(by_member, "member").otherwise("hybrid").alias("path"),
        F.when(by_member, words).otherwise(q.boosted(F.col("text"), F.col("requested"))).alias("search_text"),
        F.when(conflict, CONFLICT).alias("failure"),
        versions.alias("doc_versions"),
        "doc_sets",
        "source_kind",
        "doc_type",
        "source_name",
    )


def citation_questions(asked: DataFrame) -> DataFrame:
    """asked, as its citations are looked for: by words only, a member's names alone, those of the first of several after the question."""
    words = lambda m: F.concat_ws(" ", F.replace(m["type"], F.lit("."), F.lit(" ")), m["method"])
    exact = F.col("member.signature").isNotNull()
    text = F.when(F.col("member").isNotNull(), words(F.col("member"))).when(F.col("first_member").isNotNull(), F.concat_ws(" ", "text", words(F.col("first_member")))).otherwise(F.col("text"))
    return asked.withColumn("path", F.lit("member")).withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("search_text", text)


def question_scopes(asked: DataFrame) -> DataFrame:
    """(query, scope, path, exact, and an array of allowed values for each of FIELDS, empty for any): a scope for each requested release, or one."""
    fan = F.when(F.size("requested") > 0, F.transform("requested", lambda v, i: F.struct(i.alias("scope"), F.array(v).alias("version")))).otherwise(F.array(F.struct(F.lit(0).alias("scope"), F.col("doc_versions").alias("version"))))
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    member = lambda c: F.when(F.col("path") == "member", one(c)).otherwise(F.array().cast("array<string>"))
    places = F.when(F.col("exact"), F.array(*map(F.lit, DOCUMENTATION))).when(F.col("path") == "member", F.array(*map(F.lit, OFFICIAL_COLLECTIONS))).otherwise(F.array().cast("array<string>"))
    live = asked.where("failure IS NULL").withColumn("fan", F.explode(fan))
    return live.select(
        "query",
        F.col("fan.scope").alias("scope"),
        "path",
        "exact",
        F.col("fan.version").alias("version"),
        *(one(F.col(c)).alias(c) for c in ("source_kind", "doc_type", "source_name")),
        F.col("doc_sets").alias("doc_set"),
        places.alias("collection"),
        member(F.when(F.col("member").isNotNull(), F.concat(F.col("member.type"), F.lit(".html")))).alias("type_page"),
        member(F.col("member.package")).alias("package"),
        F.when(F.col("exact"), one(F.concat("member.method", "member.signature"))).otherwise(F.array().cast("array<string>")).alias("anchor"),
    )


def candidates(asked: DataFrame, scopes: DataFrame, points: DataFrame, words: DataFrame, meaning: DataFrame | None, key: str, k: int, prefetch: int, digits: int = 9) -> DataFrame:
    """(query, scope, key, score, rank): the k best rows of each scope.

    words: (query, scope, key, score, rank), the rows of each scope that isn't exact by shared terms, `prefetch` at least. meaning: (query, scope, key, rank), each hybrid scope's rows of the nearest vectors, or None. On the hybrid path both rankings' `prefetch` best of a
    scope are fused by reciprocal rank; a member's question takes the words' best; an exact one takes all entries that its scope admits,
    each of score 1, in the order of key, without a look at its words.
    """
    paths = words.join(scopes.where("NOT exact").select("query", "scope", "path"), ["query", "scope"])
    parts = [paths.where((F.col("path") == "member") & (F.col("rank") <= k)).select("query", "scope", key, "score", "rank")]
    rankings = [paths.where((F.col("path") == "hybrid") & (F.col("rank") <= prefetch)), *([] if meaning is None else [meaning.where(F.col("rank") <= prefetch)])]
    fused = fusion.reciprocal_rank_fusion(rankings, ["query", "scope"], key).withColumn("score", F.round("score", digits))
    parts.append(sparse.top_k(fused, ["query", "scope"], key, k))
    entries = in_scopes(points.select(key, *FIELDS), scopes.where("exact"), FIELDS, ["query", "scope"]).select("query", "scope", key, F.lit(1.0).alias("score"))
    parts.append(sparse.top_k(entries, ["query", "scope"], key, k))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_seen_of_questions(found: DataFrame, version: str, content_hash: str, url: str) -> DataFrame:
    """found (by query, scope and rank) without rows whose (version, hash), or without a hash whose URL, an earlier row of the question has. Candidates are a top-k, so a question's are few."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    same = F.when(~blank(content_hash), F.concat_ws("\0", F.lit("h"), F.coalesce(version, F.lit("")), content_hash)).when(~blank(url), F.concat_ws("\0", F.lit("u"), url))
    n = F.row_number().over(W.partitionBy("query", "__same").orderBy("scope", "rank"))
    return found.withColumn("__same", same).withColumn("__n", n).where("__n = 1 OR __same IS NULL").drop("__same", "__n")


def _declared(text: Column, method: Column) -> Column:
    """Whether text has the method's name as a whole identifier, followed by a parenthesis."""
    part = r"\p{javaJavaIdentifierPart}"
    return F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(rf"(?<!{part})\Q"), method, F.lit(rf"\E(?!{part})\p{{javaWhitespace}}*\(")))


def citation_tier(member: Column, doc_type: Column, path: Column, package: Column, text: Column) -> Column:
    """0: a page of the member's type with a declaration of it, 1: such a page, 2: a declaration elsewhere, 3: others, and everything but API documentation.

    path: of the page's URL; package: that its URL names, for members that name none.
    """
    own = F.when(member["package"] != "", member["package"]).otherwise(F.coalesce(package, F.lit("")))
    page = (own != "") & F.endswith(path, F.concat(F.lit("/"), F.replace(own, F.lit("."), F.lit("/")), F.lit("/"), member["type"], F.lit(".html")))
    page, declared = F.coalesce(page, F.lit(False)), _declared(text, member["method"])
    return F.when(doc_type.isNull() | (doc_type != API_DOCS), 3).when(page & declared, 0).when(page, 1).when(declared, 2).otherwise(3)


def own_entry(member: Column, doc_type: Column, type_page: Column, package: Column, anchor: Column) -> Column:
    """Whether a row is an entry of the member itself: of its exact overload if it has a signature, else of any of its name."""
    named = F.when(member["signature"].isNotNull(), anchor == F.concat(member["method"], member["signature"])).otherwise(F.regexp_extract(anchor, r"^([^(]+)\(", 1) == member["method"])
    stored = (doc_type == API_DOCS) & (type_page == F.concat(member["type"], F.lit(".html"))) & ((member["package"] == "") | (package == member["package"]))
    return F.coalesce(named & stored, F.lit(False))


def in_citation_order(found: DataFrame) -> DataFrame:
    """found with its member's own entries only, if the question names one of the platform, else all by tiers of the first member; order is their place.

    Columns: member, first_member, doc_type, type_page, package, anchor, url_path, url_package, text. An overload that nobody has leaves nothing.
    """
    mine = own_entry(F.col("member"), F.col("doc_type"), F.col("type_page"), F.col("package"), F.col("anchor"))
    overload = F.coalesce(F.col("member.signature").isNotNull(), F.lit(False))
    tier = F.when(F.col("first_member").isNotNull() & ~overload, citation_tier(F.col("first_member"), F.col("doc_type"), F.col("url_path"), F.col("url_package"), F.col("text")))
    kept = found.where(F.col("member").isNull() | mine).withColumn("tier", F.coalesce(tier, F.lit(0)))
    return kept.withColumn("order", F.row_number().over(W.partitionBy("query").orderBy("tier", "scope", "rank"))).drop("tier")


def cover_releases(rows: Column, requested: Column, limit: int) -> Column:
    """The first `limit` of rows (array of structs with version) with every requested release: the first row of a missing one comes last if there is room, else
    in the place of the last row whose release is not requested or has several. Null if that can't be done."""

    def take(kept: Column, v: Column) -> Column:
        new = F.slice(F.filter(rows, lambda r: r["version"] == v), 1, 1)
        spare = lambda i: ~F.array_contains(requested, F.element_at(kept, i)["version"]) | (F.size(F.filter(kept, lambda r: r["version"] == F.element_at(kept, i)["version"])) > 1)
        place = F.array_max(F.filter(F.sequence(F.lit(1), F.size(kept)), spare))
        swapped = F.concat(F.slice(kept, F.lit(1), place - 1), new, F.slice(kept, place + 1, F.size(kept)))
        return F.when(F.exists(kept, lambda r: r["version"] == v), kept).when(F.size(new) == 0, None).when(F.size(kept) < limit, F.concat(kept, new)).otherwise(swapped)

    return F.when((F.size(requested) == 0) | (F.size(requested) <= limit), F.aggregate(requested, F.slice(rows, 1, limit), take))


def answers(asked: DataFrame, found: DataFrame, key: str, limit: int) -> DataFrame:
    """(query, failure, rows): rows is an array of (order, key, version, score), at most `limit`; empty if there is a failure.

    found: query, order, key, version, score. Each requested release must have a row, and a member's question some.
    """
    listed = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("order").cast("long").alias("order"), key, "version", "score"))).alias("rows"))
    empty = F.array().cast(listed.schema["rows"].dataType)
    both = asked.join(listed, "query", "left").withColumn("rows", F.coalesce("rows", empty))
    missing = F.get(F.filter("requested", lambda v: ~F.exists("rows", lambda r: r["version"] == v)), 0)
    nothing = (F.col("path") == "member") & F.col("member").isNotNull() & (F.size("rows") == 0)
    failure = F.coalesce("failure", F.when(nothing, NO_MEMBER), F.concat(F.lit(NO_RELEASE), missing), F.when(F.size("requested") > limit, NO_ROOM))
    both = both.withColumn("failure", failure)
    return both.select("query", "failure", F.when(F.col("failure").isNull(), cover_releases(F.col("rows"), F.col("requested"), limit)).otherwise(empty).alias("rows"))


def require_answers(answered: DataFrame) -> DataFrame:
    """answered, in which a failure is an error where rows are made."""
    return answered.withColumn("rows", F.when(F.col("failure").isNull(), F.col("rows")).otherwise(F.raise_error(F.coalesce("failure", F.lit("")))))


def context_texts(answered: DataFrame, docs: DataFrame, key: str, text: str, tokens: int) -> DataFrame:
    """(query, failure, place, key, version, score, text, truncated): a row for each document of an answer, its text cut to the tokens; one without a document for failures."""
    placed = answered.select("query", "failure", F.posexplode_outer("rows").alias("at", "row")).select("query", "failure", (F.col("at") + 1).alias("place"), f"row.{key}", "row.version", "row.score")
    # Answers are few: once written, their documents are found by their measured size, and only those are cut.
    placed = settled(placed, "answers")
    found = docs.join(placed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select(F.col(key).alias("__key"), truncated(F.col(text), tokens).alias("cut"))
    return placed.join(found, F.col(key) == F.col("__key"), "left").select("query", "failure", "place", key, "version", "score", "cut.text", "cut.truncated")
