"""Pages: links, clean text, guard and page sections. A small tree on the standard parser; applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is removed, where content is looked for (in this order), and lines and phrases that are noise.
REMOVED = ["nav", "header", "footer", ".navigation", ".nav", ".navbar", ".sidebar", ".toc", ".breadcrumb", ".skip-nav", ".skip-link", "script", "style", "noscript", ".footer", ".header", ".copyright", ".legal", "#navigation", "#nav"]
CONTENT = ["main", "article", ".content-container", ".main-content", ".documentation", ".doc-content", "#content", ".block", ".description", ".detail", ".summary"]
NOISE = ["JavaScript is disabled", "Skip navigation links", "Hide sidebar", "Show sidebar", "Report a bug", "suggest an enhancement", "Other versions", "Use is subject to license terms", "Scripting on this page tracks", "but does not change the content"]
MIN_CONTENT, MIN_INLINE, SHORT_LINE, MOST_NOISE = 500, 20, 3, 3
ERROR_TITLES = {"access denied", "403 forbidden", "404 not found", "page not found"}
CHALLENGE_TITLE = "just a moment..."

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "br", "section", "article", "main", "body", "html", "head", "title", "dl", "dt", "dd", "header", "footer", "nav", "blockquote"}
#: Elements that an opening tag ends: a new list item ends the one before.
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "div", "body", "html", "section", "article", "main", "dl"}


def lower(x: str) -> str:
    return x.encode().lower().decode()


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = list(reversed(self.elements))
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.elements))

    def whole_text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def text(self) -> str:
        """Words of all text below by single spaces; blocks part words."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is None:
                out.append(" ")
            elif x.tag not in ("script", "style"):
                block = x.tag in BLOCKS
                stack.extend([None] if block else [])
                stack.extend(reversed(x.children))
                stack.extend([None] if block else [])
        return " ".join("".join(out).split())

    def own_text(self) -> str:
        return " ".join("".join(c for c in self.children if isinstance(c, str)).split())

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in self.attributes.get("class", "").split()
        return self.attributes.get("id") == selector[1:] if selector[0] == "#" else self.tag == selector

    def find(self, *selectors: str) -> list[Node]:
        return [x for x in self.walk() if any(x.matches(s) for s in selectors)]

    def remove(self, *selectors: str) -> None:
        stack = [self]
        while stack:
            x = stack.pop()
            x.children = [c for c in x.children if isinstance(c, str) or not any(c.matches(s) for s in selectors)]
            stack.extend(x.elements)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})

    def handle_starttag(self, tag, attrs):
        up = self.at
        while up.parent is not None and up.tag not in SCOPES:
            if up.tag in ENDS.get(tag, ()):
                self.at = up.parent
                break
            up = up.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None:
            if up.tag == tag:
                self.at = up.parent
                return
            up = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def links(html: str | None, base: str) -> list[str]:
    """Absolute targets of all a[href] without fragments, each once, in their order; what is no http(s) URL is left out."""
    found = (urldefrag(urljoin(base, a.attributes["href"].strip()))[0] for a in parse(html).find("a") if a.attributes.get("href", "").strip())
    return list(dict.fromkeys(u for u in found if u.startswith(("http://", "https://"))))


def is_navigation(x: Node) -> bool:
    name, own, text = lower(x.attributes.get("class", "")), lower(x.attributes.get("id", "")), lower(x.text())
    return any(w in name for w in ("nav", "menu", "sidebar", "header", "footer")) or any(w in own for w in ("nav", "menu")) or text.startswith(("skip", "hide", "show"))


def excessive_noise(text: str) -> bool:
    low = lower(text)
    return sum(lower(n) in low for n in NOISE) > MOST_NOISE


def main_content(root: Node) -> Node | None:
    """The longest match of the first content selector that has any; else the longest div that reads like content."""
    for selector in CONTENT:
        if found := root.find(selector):
            return max(found, key=lambda e: len(e.text()))
    divs = [d for d in root.find("div") if len(t := d.text()) > MIN_CONTENT and not is_navigation(d) and not excessive_noise(t)]
    return max(divs, key=lambda e: len(e.text())) if divs else None


def _list(x: Node, out: list[str]) -> None:
    """The items of a list, and of the lists in them. Nested lists are on a stack of their own, so no page is nested too deep."""
    stack: list[tuple[Node, int | None]] = [(x, 0)]
    while stack:
        x, depth = stack.pop()
        if depth is None:
            _formatted(x, out)
        elif x.tag == "li":
            if own := x.own_text():
                out.append("\n" + "  " * depth + "• " + own)
            stack.extend((c, depth + 1 if c.tag in ("ul", "ol") else None) for c in reversed(x.elements))
        else:
            stack.extend((c, depth) for c in reversed(x.elements) if c.tag == "li")


def _formatted(x: Node, out: list[str]) -> None:
    text = x.text()
    if not text:
        return
    if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out.append(f"\n\n{text}\n")
    elif x.tag in ("pre", "code"):
        out.append(f"\n```\n{x.whole_text()}\n```\n")
    elif x.tag in ("ul", "ol"):
        _list(x, out)
        out.append("\n")
    elif x.tag == "table":
        out.extend("\n" + " | ".join(c.text() for c in row.find("td", "th")) for row in x.find("tr"))
        out.append("\n")
    elif is_navigation(x):
        return
    elif x.tag in ("p", "div"):
        out.append(f"\n{text}")
    elif len(text) > MIN_INLINE:
        out.append(f" {text}")


def structured_text(x: Node) -> str:
    """Headings, paragraphs, fences, lists and tables if there are headings or paragraphs; else the plain text."""
    if not x.find("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        return x.text()
    out: list[str] = []
    for child in x.elements:
        _formatted(child, out)
    return "".join(out).strip()


def without_noise(text: str) -> str:
    """Without noise lines and short lines that begin without a capital, A-Z; fences are kept; blanks outside fences are collapsed."""
    noise, out, fenced = {lower(n) for n in NOISE}, [], False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            out.append(line)
        elif fenced:
            out.append(line)
        elif not bare:
            if out and out[-1] == "" or not out:
                continue
            out.append("")
        elif lower(bare) not in noise and (len(bare) > SHORT_LINE or "A" <= bare[0] <= "Z"):
            indent = line[: len(line) - len(line.lstrip(" "))] if bare.startswith("•") else ""
            out.append(indent + " ".join(bare.split(" ")) if "  " not in bare else indent + " ".join(bare.split()))
    return "\n".join(out).strip()


def clean_text(html: str | None) -> str:
    root = parse(html)
    root.remove(*REMOVED)
    body = next(iter(root.find("body")), root)
    return without_noise(structured_text(main_content(root) or body))


def rejection(html: str | None) -> str | None:
    """Why a page is no document, or None: a challenge page, a CDN's or server's error page, or an empty body."""
    return page_facts(html)[1]


def page_facts(html: str | None) -> tuple[str, str | None]:
    """(text, rejection) of a page that is parsed once."""
    root = parse(html)
    text_of = lambda x: lower(x.text().strip()) if x is not None else ""

    def heading(*paths: tuple[str, ...]) -> str:
        """Of the first h1 whose parents up to the body are those of a path."""
        for x in root.find("h1"):
            above, at = [], x.parent
            while at is not None and at.tag != "body":
                above.append(at.tag)
                at = at.parent
            if at is not None and tuple(above) in paths:
                return text_of(x)
        return ""

    title = text_of(next(iter(root.find("title")), None))
    robots = [m for m in root.find("meta") if m.attributes.get("name") == "robots" and m.parent is not None and m.parent.tag == "head"]
    noindex = any("noindex" in [d.strip() for d in lower(m.attributes.get("content", "")).split(",")] for m in robots)
    script = any("/cdn-cgi/challenge-platform/" in s.attributes.get("src", "") for s in root.find("script"))
    stage = root.find("#challenge-stage", "#cf-chl-widget") or [x for x in root.find("#challenge-form") if x.tag == "form"]
    code = any(c.find(".cf-error-code") for c in root.find("#cf-error-details"))
    error = title in ERROR_TITLES and (title == heading((), ("center",)) or noindex and title == heading(("main",)))
    root.remove(*REMOVED)
    text = without_noise(structured_text(main_content(root) or next(iter(root.find("body")), root)))
    if title == CHALLENGE_TITLE and script and stage:
        return text, "challenge structure"
    if code:
        return text, "CDN error structure"
    if error:
        return text, "error page structure"
    return text, None if text else "empty body text"


def page_sections(html: str | None) -> list[tuple[str, str]]:
    """(anchor, text): the overview and then each section.detail with an id; just the whole text for other pages."""
    root = parse(html)
    details = [s for s in root.find("section") if "detail" in s.attributes.get("class", "").split() and s.attributes.get("id")]
    if not details:
        return [("", clean_text(html))]
    members = [(s.attributes["id"], without_noise(structured_text(s))) for s in details]
    root.remove(*REMOVED)
    for s in details:
        s.children = []
    return [("", without_noise(structured_text(main_content(root) or next(iter(root.find("body")), root)))), *members]


def map_pages(pages: DataFrame, key: str, columns: list[str], function: Callable, name: str, kind: pa.DataType, schema: str) -> DataFrame:
    """(key, name): function of the columns, row by row within Arrow batches."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i + 1).to_pylist() for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([function(*r) for r in rows], kind)], [key, name])

    return pages.select(key, *columns).mapInArrow(apply, f"{key} {pages.schema[key].dataType.simpleString()}, {name} {schema}")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, position, link)."""
    found = map_pages(pages, key, [html, url], links, "links", pa.list_(pa.string()), "array<string>")
    return found.select(key, F.posexplode("links").alias("position", "link"))


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, rejection)."""
    both = lambda h: dict(zip(("text", "rejection"), page_facts(h)))
    out = map_pages(pages, key, [html], both, "page", pa.struct([("text", pa.string()), ("rejection", pa.string())]), "struct<text string, rejection string>".replace(" string", ":string"))
    return out.select(key, "page.*")
