"""Index maintenance: markers, upserts, replacement, audit. Tables are DataFrames; every operator returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pages of one site's API that an index should no longer hold: lists of uses, and root pages.
RETIRED_PAGE = r"^https://docs\.oracle\.com/en/java/javase/[0-9]+/docs/api/(?:(?:.*/)?class-use/|[A-Z][A-Za-z0-9_$]*\.html(?:[?#].*)?$)"


def chunk_decisions(chunks: DataFrame, markers: DataFrame, force: Column | bool = False) -> DataFrame:
    """chunks (hash, title, package, ...) with decision: skip if the hash has a marker with equal trimmed title and package, else new or changed."""
    force = force if isinstance(force, Column) else F.lit(force)
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    old = markers.select(F.col("hash").alias("__hash"), trimmed(F.col("title")).alias("__title"), trimmed(F.col("package")).alias("__package"))
    joined = chunks.join(old, chunks["hash"] == old["__hash"], "left")
    same = (trimmed(chunks["title"]) == F.col("__title")) & (trimmed(chunks["package"]) == F.col("__package"))
    decision = F.when(F.col("__hash").isNull(), "new").when(force, "forced").when(same, "skip").otherwise("changed")
    return joined.withColumn("decision", decision).drop("__hash", "__title", "__package")


def file_decisions(files: DataFrame, markers: DataFrame, fields: list[str], url: str = "url") -> DataFrame:
    """files with decision: unchanged if a marker of the URL agrees in all fields (null equals null), else new or changed."""
    old = markers.select(F.col(url).alias("__url"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = files.join(old, files[url] == old["__url"], "left")
    same = F.lit(True)
    for c in fields:
        same = same & files[c].eqNullSafe(F.col(f"__{c}"))
    decision = F.when(F.col("__url").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return joined.withColumn("decision", decision).drop("__url", *(f"__{c}" for c in fields))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def replace_url(table: DataFrame, rows: DataFrame, url: str = "url", key: str = "point_id") -> DataFrame:
    """table with rows as all that their URLs have: prior rows of these URLs go, whatever their key, and so do rows of the same keys."""
    return upsert(table.join(rows.select(url).distinct(), url, "left_anti"), rows, key)


def stale_keys(prior: DataFrame, replacement: DataFrame, *keys: str) -> DataFrame:
    """Rows of prior whose keys the replacement lacks."""
    return prior.join(replacement.select(*keys), list(keys), "left_anti")


def identity_by_url(stored: DataFrame, expected: DataFrame, url: str = "url", key: str = "point_id") -> DataFrame:
    """(url, stored, expected, exact): exact if both have the same keys and none repeats one."""
    count = lambda df, name: df.groupBy(url, key).agg(F.count(F.lit(1)).alias(name))
    both = count(stored, "s").join(count(expected, "e"), [url, key], "full_outer")
    return both.groupBy(url).agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("stored"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected"),
        F.min((F.coalesce("s", F.lit(0)) == 1) & (F.coalesce("e", F.lit(0)) == 1)).alias("exact"),
    )


def audit(expected: DataFrame, stored: DataFrame, by: str = "url", key: str = "hash") -> DataFrame:
    """(by, parsed, stored, missing, extra, duplicates, ok): hashes expected and stored; duplicates are hashes stored more than once."""
    e = expected.groupBy(by, key).agg(F.count(F.lit(1)).alias("e"))
    s = stored.groupBy(by, key).agg(F.count(F.lit(1)).alias("s"))
    both = e.join(s, [by, key], "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = both.groupBy(by).agg(
        one(F.col("e").isNotNull()).alias("parsed"), F.coalesce(F.sum("s"), F.lit(0)).alias("stored"), one(F.col("s").isNull()).alias("missing"), one(F.col("e").isNull()).alias("extra"), one(F.col("s") > 1).alias("duplicates")
    )
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0))


def sample_of(hashes: DataFrame, key: str = "hash", n: int = 20) -> DataFrame:
    """The first n in order."""
    return hashes.select(key).orderBy(key).limit(n)


def by_hash_prefix(files: DataFrame, hashes: DataFrame, digits: int = 12, prefix: str = "prefix", key: str = "hash") -> DataFrame:
    """files (prefix: the first digits of a hash) whose prefix some hash has. An equi-join on the cut hash."""
    return files.join(hashes.select(F.substring(key, 1, digits).alias(prefix)).distinct(), prefix, "left_semi")


def retired_pages(points: DataFrame, url: str = "url") -> DataFrame:
    return points.where(F.col(url).rlike(RETIRED_PAGE))


def set_payload(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """table with columns set where the condition holds; nothing to set changes nothing."""
    return table.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()}) if values else table


def required_counts(points: DataFrame, required: DataFrame, column: str = "doc_set") -> DataFrame:
    """(column, points, ok): points of every required value; ok if there are any."""
    counts = points.groupBy(column).agg(F.count(F.lit(1)).alias("points"))
    return required.select(column).distinct().join(counts, column, "left").select(column, F.coalesce("points", F.lit(0)).alias("points")).withColumn("ok", F.col("points") > 0)


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """rows with the columns of the root whose path is the row's or above it, the longest; null if none.

    Every path is looked up by each of its own leading directories, so roots are joined by equality at any number.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = rows.select(path).distinct()
    found = paths.select(path, F.explode(levels).alias(root)).join(roots, root)
    best = found.groupBy(path).agg(F.max_by(F.struct(*roots.columns), F.length(root)).alias("__root"))
    return rows.join(best, path, "left").select(*rows.columns, "__root.*")


def delete_url(table: DataFrame, doc_url: str | None, url: str = "url") -> DataFrame:
    """table without the rows of a URL; a blank one deletes nothing."""
    return table.where(~F.col(url).eqNullSafe(doc_url)) if (doc_url or "").strip() else table


def delete_points(table: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def points_of_urls(table: DataFrame, wanted: DataFrame, url: str = "url", key: str = "point_id") -> DataFrame:
    """(url, points, first_point) of every wanted URL, 0 if it has none."""
    counts = table.groupBy(url).agg(F.count(F.lit(1)).alias("points"), F.min(key).alias("first_point"))
    return wanted.select(url).distinct().join(counts, url, "left").select(url, F.coalesce("points", F.lit(0)).alias("points"), "first_point")


def sufficient_coverage(files: DataFrame, stored: DataFrame, url: str = "url", expected: str = "expected") -> DataFrame:
    """files with covered: the URL has points, and at least as many as are expected (if any are)."""
    counts = stored.groupBy(F.col(url).alias("__url")).agg(F.count(F.lit(1)).alias("__points"))
    joined = files.join(counts, files[url] == counts["__url"], "left")
    points, wanted = F.coalesce("__points", F.lit(0)), F.coalesce(expected, F.lit(0))
    return joined.withColumn("covered", (points > 0) & ((wanted <= 0) | (points >= wanted))).drop("__url", "__points")


def require_schema(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """table, if it has every wanted column in its type; else an error that names the first that it lacks."""
    have = dict(table.dtypes)
    for name, kind in wanted.items():
        if have.get(name) != kind:
            raise TypeError(f"{name} is {have.get(name, 'absent')}, not {kind}")
    return table


def discovered_collections(collections: DataFrame, prefix: str) -> DataFrame:
    """(name, status) of collections (name, valid) with the prefix; one that is not valid makes all FAILED, and none of them is used."""
    found = collections.where(F.col("name").startswith(prefix))
    whole = found.agg(F.min(F.coalesce("valid", F.lit(False))).alias("all_valid"))
    return found.join(F.broadcast(whole)).select("name", F.when(F.col("all_valid"), "READY").otherwise("FAILED").alias("status"))


def accepted_mirrors(files: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (source, min_files) with files and accepted: a staged mirror is published only if it has so many pages."""
    counts = files.where(F.col("path").rlike(r"(?i)\.html?$")).groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    joined = sources.join(counts, "source", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return joined.withColumn("accepted", F.col("files") >= F.col("min_files"))


def quarantined(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with it: two tables, nothing is lost."""
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def point_digests(points: DataFrame, url: str = "url", key: str = "point_id") -> DataFrame:
    """(url, points, digests): a digest of each URL's keys that does not depend on their order: four sums of 32 bits of two hashes, and the count.

    Equal multisets have equal digests. Sums are partial before the shuffle, so only one row per URL and task is shuffled, whatever its number of points.
    """
    one, two = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    halves = [x for h in (one, two) for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return points.groupBy(url).agg(F.count(F.lit(1)).alias("points"), F.array(*(F.sum(h) for h in halves)).alias("digests"))


def identity_differences(stored: DataFrame, expected: DataFrame, url: str = "url", key: str = "point_id") -> DataFrame:
    """(url, stored, expected, missing, extra, repeated, exact) for every URL of either side.

    Expected keys count once. URLs whose digests agree are exact; only the keys of the others meet, one by one. repeated: keys that are stored more than once.
    """
    expected = expected.select(url, key).distinct()
    s, e = (point_digests(x, url, key).select(F.col(url).alias(f"__{n}"), F.col("points").alias(n), F.col("digests").alias(f"__{n}_digests")) for x, n in ((stored, "stored"), (expected, "expected")))
    both = s.join(e, F.col("__stored") == F.col("__expected"), "full_outer").withColumn("__url", F.coalesce("__stored", "__expected"))
    both = both.select("__url", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("expected", F.lit(0)).alias("expected"), (F.col("stored").eqNullSafe(F.col("expected")) & F.col("__stored_digests").eqNullSafe(F.col("__expected_digests"))).alias("exact"))
    other = both.where("NOT exact").select(F.col("__url").alias(url))
    counted = lambda x, n: x.join(other, url, "left_semi").groupBy(url, key).agg(F.count(F.lit(1)).alias(n))
    met = counted(stored, "__s").join(counted(expected, "__e"), [url, key], "full_outer")
    found = met.groupBy(url).agg(*(F.count_if(c).alias(n) for n, c in (("missing", F.col("__s").isNull()), ("extra", F.col("__e").isNull()), ("repeated", F.col("__s") > 1))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.join(found, both["__url"] == found[url], "left").select(F.col("__url").alias(url), "stored", "expected", zero("missing"), zero("extra"), zero("repeated"), "exact")


def checked_file_decisions(files: DataFrame, markers: DataFrame, stored: DataFrame, fields: list[str], hashes: str = "hashes", url: str = "url", key: str = "point_id") -> DataFrame:
    """files with decision, as a file is ingested next to what is stored for its URL:

    new (no marker, no points), unmarked (no marker, but points: replace all), changed (a marker that differs in a field: replace all),
    differs (an equal marker whose hashes are not exactly the stored keys: replace all), else skip. markers: url, fields, and hashes, the
    array of the keys that its file had; an equal marker without any is skipped if nothing is stored. Keys are compared by digests.
    """
    listed = markers.select(url, F.explode(F.array_distinct(hashes)).alias(key))
    e = point_digests(listed, url, key).select(F.col(url).alias("__e"), F.col("points").alias("__e_points"), F.col("digests").alias("__e_digests"))
    s = point_digests(stored, url, key).select(F.col(url).alias("__s"), F.col("points").alias("__s_points"), F.col("digests").alias("__s_digests"))
    judged = file_decisions(files, markers, fields, url)
    met = judged.join(e, judged[url] == e["__e"], "left").join(s, judged[url] == s["__s"], "left")
    same = F.col("__e_points").eqNullSafe(F.col("__s_points")) & F.col("__e_digests").eqNullSafe(F.col("__s_digests"))
    decision = F.when(F.col("decision") == "new", F.when(F.col("__s").isNull(), "new").otherwise("unmarked")).when(F.col("decision") == "changed", "changed").when(same, "skip").otherwise("differs")
    return met.withColumn("decision", decision).select(*files.columns, "decision")


def require_unique(rows: DataFrame, column: str) -> DataFrame:
    """rows, if no value of the column repeats; else an error that names one that does."""
    again = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if again is not None:
        raise ValueError(f"{column} {again[column]} occurs {again['n']} times")
    return rows
