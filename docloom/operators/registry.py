"""The registry of documentation sources, and what the place of a document says about it.

Sources are a table (mirror, base_url, doc_set, source_kind, doc_version, doc_type, api), one row per mirrored directory; api: pages of an API, whose
release is doc_version. Documents meet it by equality of runs of directories, so neither table is broadcast by hint and no pair is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import ascii_lower
from docloom.functions.urls import canonical_doc_url
from docloom.tables import settled

# Where mirrors lie, where books are shown, hosts that a mirrored path may hold, and what stands for a path that has no public URL.
LOCAL, BOOKS, PDFS = "/data/docs/", "/data/docs/books/", "/pdfs/"
HOSTS = ["docs.oracle.com/", "docs.spring.io/"]
REDACTED = "(local file path redacted)"
# Beginnings of paths in one project's mirrors, in two steps, and what takes their place.
PROJECT = "spring-framework"
STEPS = [
    [("docs/current/api/current/javadoc-api/", "docs/current/javadoc-api/"), ("api/current/javadoc-api/", "docs/current/javadoc-api/")],
    [("docs/current/javadoc-api/java/", "docs/current/javadoc-api/"), ("javadoc-api/java/", "javadoc-api/")],
]
# What the beginning of a set's name, or a part of the URL, says of its source.
NAMES_OF_SETS = [("oracle/", "oracle"), ("java/", "oracle"), ("ibm/", "ibm"), ("jetbrains/", "jetbrains")]
NAMES_OF_URLS = [("oracle.com", "oracle"), ("ibm.com", "ibm"), ("jetbrains.com", "jetbrains")]
KINDS = [("oracle", "official"), ("ibm", "vendor"), ("jetbrains", "vendor")]
TYPES_OF_SETS = [("books", "book"), ("java/", "api-docs"), ("oracle/javase", "release-notes"), ("ibm/articles", "blog"), ("jetbrains/", "blog")]
TYPES_OF_URLS = [("docs.oracle.com/en/java/javase/", "api-docs"), ("/pdfs/", "pdf")]


def official_identities(sources: DataFrame) -> DataFrame:
    """(identity): sets of official sources that are no APIs, and mirrors of APIs."""
    identity = F.when(F.col("api"), F.col("mirror")).when(F.col("source_kind") == "official", F.col("doc_set"))
    return sources.select(identity.alias("identity")).where("identity IS NOT NULL")


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _from(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.length(text))


def _replaced_start(path: Column, rules: list[tuple[str, str]]) -> Column:
    out = path
    for old, new in rules[::-1]:
        out = F.when(path.startswith(old), F.concat(F.lit(new), _from(path, F.lit(len(old) + 1)))).otherwise(out)
    return out


def _first(value: Column, rules: list[tuple[str, str]], fits) -> Column:
    out = F.lit(None).cast("string")
    for part, name in rules[::-1]:
        out = F.when(fits(value, part), name).otherwise(out)
    return out


def joined_url(base: Column, relative: Column) -> Column:
    """base and relative with one slash between; directories of an API that both have count once."""
    root = F.regexp_replace(base, "/+$", "")
    rest = F.regexp_replace(_slashes(F.coalesce(relative, F.lit(""))), "^/+", "")
    rest = F.when(root.endswith("/docs/api"), F.regexp_replace(rest, "^(docs/)?api/", "")).when(root.endswith("/api"), F.regexp_replace(rest, "^api/", "")).otherwise(rest)
    return F.concat(root, F.lit("/"), rest)


def public_pdf(path: Column) -> Column:
    """Where a book is shown, else null."""
    plain = _slashes(path)
    at = F.locate(BOOKS, plain)
    name = F.substring_index(_from(plain, at + len(BOOKS)), "/", -1)
    return F.when(ascii_lower(plain).endswith(".pdf") & (at > 0), F.concat(F.lit(PDFS), name))


def embedded_url(path: Column, hosts: list[str] | None = None) -> Column:
    """The URL whose host the path holds, by the first of hosts that occurs; else null."""
    plain, out = _slashes(path), F.lit(None).cast("string")
    for host in (HOSTS if hosts is None else hosts)[::-1]:
        at = F.locate(host, plain)
        out = F.when(at > 0, F.concat(F.lit("https://"), _from(plain, at))).otherwise(out)
    return out


def _longest(rows: DataFrame, key: str, runs: Column, sources: DataFrame) -> DataFrame:
    """rows with __source: the sources row of the longest mirror among runs of the key's directories, an API before others; null if none.

    What is found is written, a row a directory, so Spark plans the join by its size: rows are not shuffled if it is small, else a directory (or null) of most rows is cut into several tasks.
    """
    wanted = rows.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(runs).alias("mirror"))
    found = wanted.join(sources, "mirror").groupBy(key).agg(F.max_by(F.struct(*sources.columns), F.struct(F.col("api"), F.length("mirror"))).alias("__source"))
    found = settled(found, "sources")
    return rows.join(found, key, "left")


def _leading(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _runs(path: Column) -> Column:
    """All runs of neighbouring directories of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/")))
    return F.when(n > 0, F.array_distinct(F.flatten(runs)))


def document_urls(rows: DataFrame, url: str, sources: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """rows with public_url: of a web address the canonical form; of a book its public path; of other files the URL that their path holds or that its mirror stands for.

    Files without any are redacted; null, blank and other texts stay. A path is looked up below the first place of mirrors in it, by the longest mirror.
    """
    trimmed = F.trim(F.col(url))
    path = F.when(trimmed.startswith("file://"), _from(trimmed, F.lit(8))).otherwise(trimmed)
    below = _from(_slashes(path), F.locate(LOCAL, _slashes(path)) + len(LOCAL))
    is_file = trimmed.startswith("file://") & (F.locate(LOCAL, _slashes(path)) > 0)
    keyed = rows.withColumn("__below", F.when(is_file, below)).withColumn("__folder", F.regexp_extract("__below", "^(.*)/[^/]*$", 1))
    found = _longest(keyed, "__folder", _leading(F.col("__folder")), sources.select("mirror", "base_url", F.lit(False).alias("api")))
    # Each step is a column of its own, as the next one reads it several times.
    found = found.withColumn("__relative", _from(F.col("__below"), F.length("__source.mirror") + 2)).withColumn("__adjusted", F.col("__relative"))
    for rules in STEPS:
        found = found.withColumn("__adjusted", _replaced_start(F.col("__adjusted"), rules))
    relative = F.when(F.col("__source.mirror").contains(PROJECT), F.col("__adjusted")).otherwise(F.col("__relative"))
    found = found.withColumn("__relative", relative).withColumn("__path", path)
    web = trimmed.startswith("http://") | trimmed.startswith("https://")
    mapped = F.when(web, trimmed).otherwise(F.coalesce(embedded_url(F.col("__path"), hosts), joined_url(F.col("__source.base_url"), F.col("__relative"))))
    found = found.withColumn("__book", public_pdf(F.col("__path"))).withColumn("__mapped", mapped).withColumn("__canonical", canonical_doc_url(F.col("__mapped")))
    out = (
        F.when(F.col(url).isNull() | (trimmed == ""), F.col(url))
        .when(web, F.col("__canonical"))
        .when(F.col("__book").isNotNull(), F.col("__book"))
        .when(~trimmed.startswith("file://"), trimmed)
        .otherwise(F.coalesce("__canonical", F.lit(REDACTED)))
    )
    return found.withColumn("public_url", out).drop("__below", "__folder", "__source", "__relative", "__adjusted", "__path", "__book", "__mapped", "__canonical")


def source_name(doc_set: Column, url: Column) -> Column:
    plain = _slashes(F.coalesce(doc_set, F.lit("")))
    by_set = F.coalesce(_first(plain, NAMES_OF_SETS, Column.startswith), F.when(F.locate("/", plain) > 1, F.substring_index(plain, "/", 1)), F.when(F.trim(plain) != "", plain))
    return F.coalesce(by_set, _first(ascii_lower(F.coalesce(url, F.lit(""))), NAMES_OF_URLS, Column.contains), F.lit(""))


def source_kind(name: Column) -> Column:
    known = _first(ascii_lower(name), KINDS, Column.__eq__)
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "").otherwise(F.coalesce(known, F.lit("unknown")))


def doc_type(doc_set: Column, url: Column) -> Column:
    by_set = _first(_slashes(F.coalesce(doc_set, F.lit(""))), TYPES_OF_SETS, Column.startswith)
    return F.coalesce(by_set, _first(ascii_lower(F.coalesce(url, F.lit(""))), TYPES_OF_URLS, Column.contains), F.lit(""))


def doc_version(doc_set: Column, url: Column) -> Column:
    """The first number in the set's name, else in the URL."""
    numbers = [F.regexp_extract(F.coalesce(x, F.lit("")), "([0-9]+)", 1) for x in (doc_set, url)]
    return F.when(numbers[0] != "", numbers[0]).otherwise(numbers[1])


def provenance(rows: DataFrame, root: str, path: str, url: str, sources: DataFrame) -> DataFrame:
    """rows with doc_set, doc_path, source_name, source_kind, doc_version and doc_type of the file `path`, read from below `root`.

    The root's mirror is the longest that it holds; the source is the longest mirror at the beginning of mirror, rest of the root and path below
    the root, an API before others. Files of no source are named by the root's last directory and judged by that and the URL.
    """
    r, f = F.regexp_replace(_slashes(F.col(root)), "/+$", ""), _slashes(F.col(path))
    by_length = sources.select("mirror", F.lit(False).alias("api"))
    known = _longest(rows.withColumn("__root", r), "__root", _runs(F.col("__root")), by_length).withColumnRenamed("__source", "__known")
    mirror, inside = F.col("__known.mirror"), F.concat(F.col("__root"), F.lit("/"))
    suffix = F.regexp_replace(F.call_function("substring_index", inside, F.concat(F.lit("/"), mirror, F.lit("/")), F.lit(-1)), "/$", "")
    below = F.when(f.startswith(inside), _from(f, F.length(inside) + 1)).otherwise("")
    whole = F.when(mirror.isNull(), below).otherwise(F.array_join(F.filter(F.array(mirror, suffix, below), lambda x: F.trim(x) != ""), "/"))
    placed = known.withColumns({"__below": below, "__whole": whole, "__set": F.coalesce(mirror, F.substring_index("__root", "/", -1))})
    out = _longest(placed, "__whole", _leading(F.col("__whole")), sources)
    s, own, u = F.col("__source"), F.col("__set"), F.col(url)
    api_name = source_name(s["mirror"], s["base_url"])
    of_source = lambda api, other, legacy: F.when(s.isNull(), F.trim(legacy)).when(s["api"], api).otherwise(other)
    within = _from(F.col("__whole"), F.length(s["mirror"]) + 2)
    return out.withColumns(
        {
            "doc_set": of_source(s["mirror"], s["doc_set"], own),
            "doc_path": of_source(within, within, F.col("__below")),
            "source_name": of_source(api_name, s["doc_set"], source_name(own, u)),
            "source_kind": of_source(source_kind(api_name), s["source_kind"], source_kind(source_name(own, u))),
            "doc_version": of_source(s["doc_version"], s["doc_version"], doc_version(own, u)),
            "doc_type": of_source(F.lit("api-docs"), s["doc_type"], doc_type(own, u)),
        }
    ).drop("__root", "__known", "__below", "__whole", "__set", "__source")


def pdf_title(metadata: Column, file_name: Column) -> Column:
    """The rest of the line after the first "title:" of the metadata, else the file's name without its ending."""
    plain = F.replace(F.coalesce(metadata, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    title = F.trim(F.regexp_extract(plain, r"(?i)title:([^\n]*)", 1))
    return F.when(title != "", title).otherwise(F.regexp_replace(file_name, r"(?s)^(.+)\.[^.]*$", "$1"))


def selected_sets(sets: DataFrame, selector: str | None, with_quick: bool = False) -> DataFrame:
    """The rows of sets (name, path, official, quick) that a selector names: tokens parted by commas, `all` alone for every canonical set, none for the canonical ones (with_quick: the quick ones).

    An official set is named by its path exactly, others by name or path in any case. Nothing named, `all` next to others, and quick sets next to
    canonical ones are errors.
    """
    tokens = list(dict.fromkeys(t for x in (selector or "").split(",") if (t := x.strip())))
    if not (selector or "").strip():
        return sets.where(F.col("quick") == with_quick)
    every = [t for t in tokens if t.lower() == "all"]
    if every and len(tokens) > 1:
        raise ValueError("all cannot be combined with other selectors")
    if every or not tokens:
        return sets.where(~F.col("quick"))
    low = [t.lower() for t in tokens]
    found = sets.where(F.when(F.col("official"), F.col("path").isin(tokens)).otherwise(F.lower(F.trim("path")).isin(low) | F.lower(F.trim("name")).isin(low)))
    kinds = found.agg(F.collect_set("quick")).first()[0]
    if not kinds:
        raise ValueError(f"no documentation set is named {', '.join(tokens)}")
    if len(kinds) > 1:
        raise ValueError("quick sets cannot be taken with canonical ones")
    return found
