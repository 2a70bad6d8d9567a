"""URL filters by association rules.

A URL becomes a set of tokens: the parts of its host and path, and the names of its query's parameters. FP-growth mines the token sets that are frequent
among labelled URLs; a set whose URLs bear the label `block` often enough, and more often than those of every smaller rule in it,
is a rule if that holds with few labels as well (a lower bound of the share counts, not the share). A rule is filed under its rarest token, and a URL is compared only with the rules that are filed under one of its own.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, settle

SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.5
#: Labelled URLs that a rule must have at least, and the one-sided normal quantile of the bound that its confidence must reach.
HITS, Z = 5, 1.645
BLOCK = "label=block"
#: Fixed rules, by name: host, start of the path, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path and query; empty without "://"."""
    place = F.locate("://", url)
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    after = F.regexp_replace(rest, r"(?s)^[^/?#]*", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(after, r"(?s)^[^?#]*", 0), query


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: h:part of the host, w:word of a part, p:part of the path (numbers as #), q:name of a parameter. Long ids are no words."""
    filled = lambda parts: F.filter(parts, lambda x: x != "")
    hosts = filled(F.split(host, r"\."))
    words = F.flatten(F.transform(F.filter(hosts, lambda x: x.rlike("[-_0-9]")), lambda x: filled(F.split(x, "[-_0-9]+"))))
    paths = filled(F.split(F.lower(path), "/"))
    names = filled(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    tag = lambda name, parts: F.transform(parts, lambda x: F.concat(F.lit(name), x))
    return F.array_sort(F.array_distinct(F.concat(tag("h:", hosts), tag("w:", words), tag("p:", F.transform(paths, shape)), tag("q:", names))))


def lower_bound(hits: Column, seen: Column, z: float) -> Column:
    """Of the share hits / seen: the end of Wilson's interval, so that few hits count for less."""
    p, c = hits / seen, z * z / seen
    return (p + c / 2 - z * F.sqrt(p * (1 - p) / seen + c / (4 * seen))) / (1 + c)


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, hits: int = HITS, z: float = Z) -> DataFrame:
    """(rule, tokens, pivot, confidence, support) for (tokens, block).

    A rule's token set is frequent together with the label (`support` of all rows and `hits` rows at least), the lower bound of its share of
    blocked URLs is at least `confidence` and `lift` times the share of all, and no subset with one token less does as well. An empty table,
    or one without blocked rows, has no rules. Rows that repeat count each.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule string, tokens array<string>, pivot string, confidence double, support double")
    rows = settle(labelled.select("tokens", "block"), "labelled")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("block").cast("long")).alias("blocked")).first()
    n, blocked = counts["n"], counts["blocked"] or 0
    if not blocked:
        return none
    if hits > blocked:
        return none
    # Frequent among the blocked; a token set's count among all follows by the inverted index.
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, max(support * n, hits - 0.5) / blocked)).fit(rows.where("block").select("tokens"))
    sets = settle(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits")), "itemsets")
    tokens = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    pivots = sets.select("tokens", F.explode("tokens").alias("token")).join(tokens, "token").groupBy("tokens").agg(F.min(F.struct("uses", "token")).alias("p"))
    filed = settle(sets.join(pivots, "tokens").select("tokens", "hits", F.col("p.token").alias("pivot")), "filed")
    kinds = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).select(F.col("tokens").alias("of"), "n", F.explode("tokens").alias("pivot"))
    seen = kinds.join(filed, "pivot").where(F.size(F.array_except("tokens", "of")) == 0).groupBy("tokens").agg(F.sum("n").alias("seen"))
    rules = filed.join(seen, "tokens").withColumn("confidence", F.col("hits") / F.col("seen")).where(lower_bound(F.col("hits"), F.col("seen"), z) >= max(confidence, min(1.0, lift * blocked / n)))
    rules = settle(rules.select("tokens", "pivot", "confidence", (F.col("hits") / n).alias("support")), "rules")
    smaller = rules.select(F.col("tokens").alias("inner_tokens"), F.col("confidence").alias("inner_confidence"))
    without = F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t)))
    covered = rules.select("tokens", "confidence", without.alias("inner_tokens")).join(smaller, "inner_tokens").where("inner_confidence >= confidence").select("tokens").distinct()
    return rules.join(covered, "tokens", "left_anti").select(F.array_join("tokens", " ").alias("rule"), "tokens", "pivot", "confidence", "support")


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest of RULES that fits, as (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, verdict in sorted(RULES, key=lambda r: len(r[0])):
        domain, start = name.split("/", 1)
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """For each row: page_id, host, path, rule (of the fixed ones), verdict, mined (the mined rule that blocks it, if any).

    The verdict is the fixed rule's, else block if a mined rule's tokens are all in the URL, else allow. A null URL or one without
    "://" has an empty host and path and is allowed. Of several mined rules that fit, `mined` names the one of highest confidence, of equal
    ones the last by its name. URLs of any length are read whole. Rows that repeat an id are judged each; an empty table gives no rows.
    """
    host, path, query = url_parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    # Each URL's kind of tokens is judged once, however many pages have it.
    parted = rows.select("page_id", "url", host.alias("host"), path.alias("path"), query.alias("query"))
    parted = parted.select("page_id", "host", "path", url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"))
    kinds = parted.select("tokens").distinct().select(F.col("tokens").alias("of"), F.explode("tokens").alias("pivot"))
    hits = kinds.join(rules.select("rule", "tokens", "pivot", "confidence"), "pivot").where(F.size(F.array_except("tokens", "of")) == 0)
    best = settle(hits.groupBy("of").agg(F.max(F.struct("confidence", "rule")).alias("m")).select("of", F.col("m.rule").alias("mined")), "url-hits")
    fixed = fixed_rule(F.col("host"), F.col("path"))
    judged = parted.join(best, parted["tokens"] == best["of"], "left").withColumn("fixed", fixed)
    verdict = F.coalesce("fixed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")
