"""URL, path and provenance functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized_token

# File name endings and the language that they stand for, and names without an ending.
LANGUAGE_OF_ENDING = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml",
    ".gradle": "groovy", ".properties": "properties", ".md": "markdown", ".txt": "text", ".rst": "restructuredtext", ".sh": "shell",
    ".bash": "shell", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go",
    ".rs": "rust", ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".svelte": "svelte", ".vue": "vue",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".rb": "ruby", ".swift": "swift", ".scala": "scala", ".clj": "clojure",
    ".r": "r", ".lua": "lua", ".php": "php",
}
LANGUAGE_OF_NAME = {"makefile": "make", "dockerfile": "docker", "rakefile": "ruby", "gemfile": "ruby", "cmakelists.txt": "cmake"}
DOCUMENTATION_ENDINGS = [".md", ".txt", ".rst", ".html", ".htm"]
CONFIGURATION_ENDINGS = [".xml", ".yml", ".yaml", ".json", ".toml", ".gradle", ".kts", ".properties", ".css", ".scss"]


# The site whose API pages have a needless directory, and their path.
SPRING, SPRING_API = "https://docs.spring.io/", "/spring-framework/docs/current/javadoc-api/"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def ending(name: Column) -> Column:
    """From the last dot on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def language_of_file(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(_lookup(low, LANGUAGE_OF_NAME), F.when(low.endswith(".gradle.kts"), "kotlin"), _lookup(ending(low), LANGUAGE_OF_ENDING), F.lit(""))


def doc_type_of_file(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low.isin(list(LANGUAGE_OF_NAME)), "configuration")
        .when(ending(low).isin(DOCUMENTATION_ENDINGS), "documentation")
        .when(ending(low).isin(CONFIGURATION_ENDINGS), "configuration")
        .otherwise("source-code")
    )


def canonical_doc_url(url: Column) -> Column:
    """Without doubled API path segments, on one site without a module's, and with single slashes after the scheme."""
    x = F.replace(F.replace(url, F.lit("/docs/api/api/"), F.lit("/docs/api/")), F.lit("/api/api/"), F.lit("/api/"))
    x = F.when(x.contains(SPRING), F.replace(x, F.lit(f"{SPRING_API}java/"), F.lit(SPRING_API))).otherwise(x)
    at = F.locate("://", x)
    start = F.when(at > 0, at + 2).otherwise(0)
    return F.concat(F.substring(x, F.lit(1), start), F.regexp_replace(F.substring(x, start + 1, F.length(x)), "/+", "/"))


def citation_type(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    web = low.startswith("http://") | low.startswith("https://")
    has = lambda *parts: F.lit(False) if not parts else low.contains(parts[0]) | has(*parts[1:])
    return (
        F.when(low.endswith(".pdf"), "pdf-document")
        .when(web & has("docs.oracle.com", "javadoc", "/api/", "/docs/api/"), "api-documentation")
        .when(web & has("github.com", "gitlab.com", "bitbucket.org"), "code-repository")
        .when(web, "external-link")
        .when(low.startswith("/"), "local-link")
        .otherwise("unknown")
    )


def is_citable(url: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return (low != "") & ~low.rlike("^(mailto|tel|javascript):")


def collection_of(doc_set: Column, doc_path: Column, doc_type: Column, url: Column) -> Column:
    """books, articles, pdfs or docs; the first that fits."""
    s, p, t, u = (normalized_token(x) for x in (doc_set, doc_path, doc_type, url))
    return (
        F.when(s.startswith("books"), "books")
        .when((t == "blog") | s.startswith("ibm/articles") | s.startswith("jetbrains/") | s.startswith("jetbrains\\"), "articles")
        .when(p.endswith(".pdf") | u.contains("/pdfs/") | (t == "pdf"), "pdfs")
        .otherwise("docs")
    )


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def terminal_page(url: Column) -> Column:
    """The last path segment if it is an .html page, else null."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    page = F.regexp_extract(path, r"([^/]+\.html)$", 1)
    return F.when(page != "", page)


def repository_file_url(repository: Column, revision: Column, path: Column) -> Column:
    """The file's page: each segment of the path percent-encoded."""
    parts = F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    return F.concat(repository, F.lit("/blob/"), revision, F.lit("/"), F.array_join(parts, "/"))


def repository_identity(x: Column) -> Column:
    """Trimmed and lower-cased; null unless of letters, digits, dots, underscores and hyphens."""
    low = F.lower(F.trim(x))
    return F.when(low.rlike(r"^[a-z0-9._-]+$"), low)


def collection_segment(x: Column) -> Column:
    """For collection names: a-z, 0-9 and hyphens, with part of a hash if that loses something."""
    low = F.lower(x)
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain == x, plain).otherwise(F.concat(plain, F.lit("-h"), F.substring(F.sha2(x, 256), 1, 8)))


# What the first line of a license file has, in this order and as written, and the license that it stands for.
LICENSES = [
    ("%MIT%", "MIT"), ("%Apache%2%", "Apache-2.0"), ("%GPL%3%", "GPL-3.0"), ("%GPL%2%", "GPL-2.0"), ("%BSD%3%", "BSD-3-Clause"), ("%BSD%2%", "BSD-2-Clause"), ("%ISC%", "ISC"),
    ("%MPL%2%", "MPL-2.0"), ("%LGPL%", "LGPL-3.0"), ("%AGPL%", "AGPL-3.0"), ("%Unlicense%", "Unlicense"),
]
# The roots of registered API pages.
JAVA_API_ROOTS = ["https://docs.oracle.com/en/java/javase/21/docs/api/", "https://docs.oracle.com/en/java/javase/24/docs/api/", "https://docs.oracle.com/en/java/javase/25/docs/api/"]
PACKAGE = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$"


def license_of(first_line: Column) -> Column:
    """By the first line of a license file, whose case counts; empty if it says nothing known."""
    found = F.lit(None).cast("string")
    for pattern, name in LICENSES[::-1]:
        found = F.when(F.coalesce(first_line, F.lit("")).like(pattern), name).otherwise(found)
    return F.coalesce(found, F.lit(""))


def java_package_of_url(url: Column, roots: list[str] | None = None) -> Column:
    """The package of a page below a registered API root: the directories after the module, joined by dots; empty unless there are two."""
    plain, rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), F.lit("")
    for root in roots or JAVA_API_ROOTS:
        rest = F.when(F.lower(F.substring(plain, 1, len(root))) == root.lower(), F.substring(plain, F.lit(len(root) + 1), F.length(plain))).otherwise(rest)
    parts = F.split(rest, "/")
    page = F.array_position(F.transform(parts, lambda p: p.endswith(".html")), True).cast("int")
    end = F.when(page > 0, page - 1).otherwise(F.size(parts))
    below = F.filter(F.slice(parts, F.lit(2), F.greatest(end - 1, F.lit(0))), lambda p: F.trim(p) != "")
    package = F.array_join(below, ".")
    return F.when(package.rlike(PACKAGE) & package.contains("."), package).otherwise("")


def java_package_of_text(text: Column) -> Column:
    """Of a page's text: the first word that begins with java. in the 100 characters from its first "Package " on; empty if it is no package name."""
    at = F.locate("Package ", F.coalesce(text, F.lit("")))
    words = F.split(F.substring(text, at, F.lit(100)), r"\s+")
    first = F.get(F.filter(words, lambda w: F.lower(w).startswith("java.")), 0)
    name = F.regexp_replace(first, "[,.;]$", "")
    return F.when((at > 0) & name.rlike(PACKAGE), name).otherwise("")


def java_package(url: Column, text: Column, roots: list[str] | None = None) -> Column:
    """By the URL, else by the page's text."""
    of_url = java_package_of_url(url, roots)
    return F.when(of_url != "", of_url).otherwise(java_package_of_text(text))


def in_crawl_boundary(url: Column, root: str) -> Column:
    """Same scheme, host and effective port, and a path equal to or below the root's."""
    from urllib.parse import urlsplit

    r = urlsplit(root)
    ports = {"http": "80", "https": "443"}
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    named = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]*:([0-9]+)", 1)
    port = F.when(named != "", named).otherwise(F.coalesce(_lookup(scheme, ports), F.lit("")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base = r.path.rstrip("/")
    return (scheme == r.scheme.lower()) & (host == (r.hostname or "")) & (port == str(r.port or ports.get(r.scheme.lower(), ""))) & ((path == base) | path.startswith(f"{base}/"))


# Where a link leads that is not safe, and what is shown for sources without a name of their own.
NO_LINK, A_SOURCE, A_PDF, A_PATH = "#", "Source", "PDF Document", "Local Resource"


def safe_url(url: Column) -> Column:
    """The trimmed URL if it is a web address, a path from the root or relative; other schemes, addresses that inherit one, and blanks lead nowhere."""
    t = F.trim(F.coalesce(url, F.lit("")))
    return F.when(t == "", NO_LINK).when(t.rlike("(?i)^https?:") | (t.startswith("/") & ~t.startswith("//")), t).when(t.startswith("//") | t.contains(":"), NO_LINK).otherwise(t)


def full_url(url: Column, anchor: Column) -> Column:
    """The safe URL with the anchor, unless it has one."""
    safe, a = safe_url(url), F.coalesce(anchor, F.lit(""))
    return F.when((safe != NO_LINK) & (a != "") & ~safe.contains("#"), F.concat(safe, F.lit("#"), a)).otherwise(safe)


def citation_identity(url: Column, anchor: Column) -> Column:
    """Equal for links to one place: the URL in lower case, its fragment as it is."""
    full = full_url(url, anchor)
    return F.concat(F.lower(F.regexp_extract(full, "(?s)^([^#]*)", 1)), F.regexp_extract(full, "(?s)(#.*)$", 1))


def display_source(url: Column) -> Column:
    """What a citation is called: the name of a PDF file, the host of a web address, the last part of a local path."""
    u = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(u, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    name = F.try_url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "[-_]", " "), r"\s+", " "))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    last = F.substring_index(u, "/", -1)
    return (
        F.when(u == "", A_SOURCE)
        .when(F.lower(path).endswith(".pdf"), F.when(name.isNull() | name.contains("\uFFFD"), A_SOURCE).when(clean == "", A_PDF).otherwise(clean))
        .when(u.rlike("(?i)^https?://"), F.when(host == "", A_SOURCE).otherwise(host))
        .when(u.startswith("/"), F.when(last == "", A_PATH).otherwise(last))
        .otherwise(A_SOURCE)
    )
