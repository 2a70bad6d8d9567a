"""Readers of files, sitemaps and lesson lists, and the crawl frontier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import drop_control_characters
from docloom.functions.urls import in_crawl_boundary, language_of_file
from docloom.operators import ordering
from docloom.tables import settled

# Endings of documents, directories that hold no sources, and sizes.
DOCUMENTS = r"(?i)\.(html|htm|pdf)$"
EXCLUDED = [".git", "build", "target", "node_modules", ".gradle", ".idea", ".vscode", "__pycache__", "vendor", "dist", "out", ".next", ".cache", ".npm", ".yarn", "bin", "obj"]
MOST_DOCUMENTS, MOST_SOURCE_BYTES, MOST_SITEMAP_BYTES = 1_000_000, 1 << 20, 50 << 20


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content) of pages and PDFs below root. More than MOST_DOCUMENTS are an error when they are counted by require_inventory."""
    return _listed(spark, root).where(F.col("path").rlike(DOCUMENTS))


def require_inventory(files: DataFrame) -> DataFrame:
    n = files.select("path").count()
    if n > MOST_DOCUMENTS:
        raise ValueError(f"{n} documents are more than {MOST_DOCUMENTS}")
    return files


def inventory_fingerprint(files: DataFrame, root: str) -> str:
    """A hash over all relative paths and contents in order; contents are hashed where they lie and only hashes meet, by ranges of paths."""
    place = F.expr("substring(path, position(:root in path) + length(:root))".replace(":root", f"'{root}'"))
    rows = files.select(place.alias("place"), F.sha2("content", 256).alias("hash"))
    grouped = rows.groupBy(F.sha2("place", 256).substr(1, 3).alias("slot")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "place", "hash"))), "\0"), 256).alias("h"))
    return grouped.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("slot", "h"))), "\0"), 256).alias("h")).first()["h"]


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, language, fingerprint): sources of known languages up to MOST_SOURCE_BYTES, outside excluded directories; files that are no UTF-8 or blank are left out."""
    inside = F.expr(f"substring(path, position('{root.removeprefix('file://')}' in path) + {len(root.removeprefix('file://'))})")
    parts = F.split(inside, "/")
    name = F.element_at(parts, -1)
    rows = _listed(spark, root).where((F.col("length") <= MOST_SOURCE_BYTES) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED))))
    known = rows.withColumn("language", language_of_file(name)).where("language <> ''").where(F.is_valid_utf8(F.col("content").cast("string")))
    text = drop_control_characters(F.decode("content", "UTF-8"))
    return known.select("path", text.alias("text"), "language", F.sha2("content", 256).alias("fingerprint")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def sitemap_locations(xml: str) -> list[str]:
    """Every loc of any namespace, trimmed. Too large files and document types are errors."""
    if len(xml.encode()) > MOST_SITEMAP_BYTES:
        raise ValueError("sitemap too large")
    if re.search(r"<!DOCTYPE", xml, re.IGNORECASE):
        raise ValueError("document types are not allowed")
    return [(e.text or "").strip() for e in ElementTree.fromstring(xml).iter() if e.tag.rsplit("}", 1)[-1] == "loc" and (e.text or "").strip()]


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(path, url) of sitemap files."""

    def locations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sitemap_locations(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["path", "urls"])

    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("xml"))
    return files.mapInArrow(locations, "path string, urls array<string>").select("path", F.explode("urls").alias("url"))


def seed_urls(urls: DataFrame, prefix: str, canonical: str, rejected: str | None = None, url: str = "url") -> DataFrame:
    """Distinct sorted URLs without query and fragment below prefix, which becomes the canonical one; those that match `rejected` are left out."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    kept = urls.select(plain.alias("url")).where(F.col("url").startswith(prefix))
    kept = kept.where(~F.col("url").rlike(rejected)) if rejected else kept
    return kept.select(F.concat(F.lit(canonical), F.substring("url", len(prefix) + 1, 1 << 20)).alias("url")).distinct().orderBy("url")


def mirror_path(url: Column, cut: int = 0) -> Column:
    """Where a page lies in a mirror: host and path without the first `cut` directories, index.html for directories and .html for pages without it. Null unless https, or with user, query, fragment, blanks or .. ."""
    ok = url.rlike(r"^https://[A-Za-z0-9.-]+(:[0-9]{1,5})?(/[^\s?#]*)?$") & ~url.rlike(r"/\.\.(/|$)") & ~url.contains("@")
    path = F.regexp_extract(url, r"^https://[^/]+(/.*)?$", 1)
    path = F.when(path.isin("", "/"), "/index.html").when(path.endswith("/"), F.concat(path, F.lit("index.html"))).when(path.rlike(r"\.html?$"), path).otherwise(F.concat(path, F.lit(".html")))
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    return F.when(ok, F.array_join(F.slice(parts, F.least(F.lit(cut), F.size(parts) - 1) + 1, F.size(parts)), "/"))


def assigned_json_array(text: Column, variable: str, schema: str) -> Column:
    """array of schema from `variable = [...];`."""
    return F.from_json(F.regexp_extract(text, rf"(?s){variable}\s*=\s*(\[.*?\])\s*;", 1), f"array<{schema}>")


def api_seed_urls(types: DataFrame, modules: DataFrame, base: str) -> DataFrame:
    """All pages of an API: its roots, one per module, three per package, and one per type; types (package, type), modules (package, module). Types of unknown packages are left out."""
    url = lambda *parts: F.concat(F.lit(base), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    directory = lambda: F.translate("package", ".", "/")
    roots = types.sparkSession.createDataFrame([(f"{base}{x}",) for x in ("", "index.html", "allclasses-index.html", "allpackages-index.html")], "url string")
    module = modules.select(url(F.col("module"), "/module-summary.html").alias("url"))
    package = modules.select(F.explode(F.array(*(url(F.col("module"), "/", directory(), f"/{p}.html") for p in ("package-summary", "package-tree", "package-use")))).alias("url"))
    pages = types.join(modules, "package").select(url(F.col("module"), "/", directory(), "/", F.col("type"), ".html").alias("url"))
    return roots.unionByName(module).unionByName(package).unionByName(pages).distinct().orderBy("url")


LESSON = T.StructType([T.StructField(n, T.StringType()) for n in ("slug", "title", "summary", "technology")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("keywords", "sourceReferences")])


def read_lessons(spark: SparkSession, path: str, official: DataFrame) -> DataFrame:
    """Lessons of a JSON array with doc_sets: every source reference must be an official one (column doc_set), else an error. Unknown fields are ignored."""
    lessons = spark.read.schema(LESSON).json(path, multiLine=True).where(F.col("slug").rlike("^[a-z0-9][a-z0-9-]*$") & ~F.col("slug").endswith("-"))
    named = lessons.select("slug", F.explode_outer("sourceReferences").alias("doc_set")).where("doc_set IS NOT NULL")
    unknown = named.join(official.select("doc_set"), "doc_set", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown source {unknown[0]['doc_set']} in {unknown[0]['slug']}")
    return lessons.withColumnRenamed("sourceReferences", "doc_sets")


def crawl(links: DataFrame, start: str, root: str | None = None) -> DataFrame:
    """(url, level): pages that links (source, target) reach from start, with their distance, by one join a level until none is new; each level is checkpointed. With a root, only targets within its crawl boundary."""
    spark = links.sparkSession
    edges = links.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL")
    edges = (edges.where(in_crawl_boundary(F.col("target"), root)) if root else edges).distinct().checkpoint()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen, level = spark.createDataFrame([(start, 0)], "url string, level int"), 0
    while True:
        frontier = seen.where(F.col("level") == level)
        found = edges.join(frontier, edges["source"] == frontier["url"]).select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        found = found.withColumn("level", F.lit(level + 1)).checkpoint()
        if found.isEmpty():
            return seen
        seen, level = seen.unionByName(found).coalesce(most).checkpoint(), level + 1


def crawl_in_order(links: DataFrame, start: str, redirects: DataFrame | None = None, root: str | None = None, limit: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """(place, requested, url, level, read): the requests of a crawl with a queue, in its order, from 1; at most limit of them.

    links: (source, target, at), at being a link's place in its page. redirects: (requested, url), where a request ends; others end where they begin.
    A URL is asked for once, and not if a request before ended there. A request that ends where one before did is counted, but its page is not read
    again (read is false), and only pages that are read have links. With a root, targets and ends must lie within its crawl boundary; an end outside is an error.
    through: (via, target, of) if a link leads to a group of pages, in the order of `of`; links are then (source, via, at). Pairs of pages are never made: a level's
    first link of each group meets the group once, so a level costs no more than links and groups have rows.

    A level of the queue is one join: targets come in the order of their first (parent's place, place of the link), so the same requests are reached by any limit as by
    one queue. Each level is written once, and met by equality with all levels before; no level is copied again.
    """
    spark = links.sparkSession
    inside = lambda rows: rows.where(in_crawl_boundary(F.col("target"), root)) if root else rows
    to = "target" if through is None else "via"
    edges = links.select("source", to, "at").where(f"source IS NOT NULL AND {to} IS NOT NULL")
    edges = settled(inside(edges) if through is None else edges, "links")
    groups = None if through is None else settled(inside(through.select("via", "target", "of").where("via IS NOT NULL AND target IS NOT NULL")), "groups")
    ends = redirects if redirects is not None else spark.createDataFrame([], "requested string, url string")
    ends = settled(ends.select(F.col("requested").alias("__from"), F.col("url").alias("__end")).where("__from <> __end").dropDuplicates(["__from"]), "redirects")
    ends = None if ends.isEmpty() else ends
    wanted, levels, seen, done = spark.createDataFrame([(start, 0)], "requested string, queue long"), [], [], 0
    while limit is None or done < limit:
        level = settled(_answered(wanted, ends, _union([t for _, t in seen]), root), "level")
        count = level.count()
        if limit is not None and done + count > limit:
            level, count = settled(level.orderBy("queue").limit(limit - done), "level"), limit - done
        if not count:
            break
        levels.append(level.withColumn("level", F.lit(len(levels))))
        done += count
        # Tables of as many levels are merged, so there are few, and a level is copied a few times only.
        seen.append((1, level.select(F.explode(F.array(F.struct(F.col("requested").alias("__seen"), F.lit(False).alias("__ended")), F.struct(F.col("url").alias("__seen"), F.lit(True).alias("__ended")))).alias("x")).select("x.*").distinct()))
        while len(seen) > 1 and seen[-1][0] == seen[-2][0]:
            (n, a), (_, b) = seen.pop(), seen.pop()
            seen.append((2 * n, settled(a.unionByName(b), "seen")))
        pages = level.where("read").select(F.col("url").alias("source"), F.col("queue").alias("__parent"))
        reached, order = edges.join(pages, "source").groupBy(to).agg(F.min(F.struct("__parent", "at")).alias("first")), ["__parent", "at"]
        if groups is not None:
            order = [*order, "of"]
            reached = groups.join(reached, "via").groupBy("target").agg(F.min(F.struct("first.__parent", "first.at", "of")).alias("first"))
        # Numbers that increase along the order are enough; the dense places are made at the end.
        wanted = ordering.ranges(reached.select(F.col("target").alias("requested"), "first.*"), order).select("requested", F.col(ordering.AT).alias("queue"))
    every = _union(levels) if levels else _answered(wanted, ends, None, root).limit(0).withColumn("level", F.lit(0))
    return ordering.numbered(every, ["level", "queue"], "place").select((F.col("place") + 1).alias("place"), "requested", "url", "level", "read")


def _union(tables: list[DataFrame]) -> DataFrame | None:
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out


def _answered(wanted: DataFrame, ends: DataFrame | None, seen: DataFrame | None, root: str | None) -> DataFrame:
    """The requests of a level that are made: (requested, url, queue, read). ends: where requests end elsewhere; seen: URLs that were asked for, or where a request __ended."""
    asked = wanted.select("requested", "queue", F.col("requested").alias("url")) if ends is None else wanted.join(ends, F.col("requested") == F.col("__from"), "left").select("requested", "queue", F.coalesce("__end", "requested").alias("url"))
    if root:
        asked = asked.withColumn("url", F.when(in_crawl_boundary(F.col("url"), root), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("a redirect leaves the crawl: "), "url"))))
    if seen is not None:
        asked = asked.join(seen, F.col("requested") == F.col("__seen"), "left_anti")
    if ends is None:
        return asked.withColumn("read", F.lit(True))
    asked = settled(asked, "asked")
    made = asked.join(_left_out(asked), F.col("requested") == F.col("__out"), "left_anti")
    # Of requests that end at one page the first reads it, if no level before did.
    first = made.groupBy(F.col("url").alias("__url")).agg(F.min("queue").alias("__first"))
    judged = made.join(first, F.col("url") == F.col("__url")).withColumn("read", F.col("queue") == F.col("__first"))
    if seen is not None:
        before = seen.where("__ended").select(F.col("__seen").alias("__before")).distinct()
        judged = judged.join(before, F.col("url") == F.col("__before"), "left").withColumn("read", F.col("read") & F.col("__before").isNull())
    return judged.select("requested", "url", "queue", "read")


def _left_out(asked: DataFrame) -> DataFrame:
    """(__out): requests of a level at which one before them, that is made, ended. Only redirects end elsewhere; a chain of them settles from its first on."""
    moved, out = asked.where("requested <> url"), None
    while True:
        made = moved if out is None else moved.join(out, F.col("requested") == F.col("__out"), "left_anti")
        first = made.groupBy(F.col("url").alias("__to")).agg(F.min("queue").alias("__before"))
        now = settled(asked.join(first, (F.col("requested") == F.col("__to")) & (F.col("queue") > F.col("__before"))).select(F.col("requested").alias("__out")), "left-out")
        if now.isEmpty() if out is None else now.count() == out.count() and now.join(out, "__out", "left_anti").isEmpty():
            return now
        out = now


def unmatched_types(types: DataFrame, modules: DataFrame) -> DataFrame:
    """(package, types): what api_seed_urls leaves out, as no module has the package."""
    return types.join(modules.select("package").distinct(), "package", "left_anti").groupBy("package").agg(F.count(F.lit(1)).alias("types"))
