"""Whether a staged mirror holds the release that it is published as."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.html import Node, lower, map_pages, parse


def declared_versions(root: Node) -> list[str]:
    """Contents of meta elements named version."""
    named = [m.attributes for m in root.find("meta") if lower(m.attributes.get("name", "")) == "version"]
    return [a["content"].strip() for a in named if a.get("content")]


def visible_words(root: Node) -> str:
    """All words outside scripts and styles, by single spaces; elements part words."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out += x.split()
        elif x.tag not in ("script", "style"):
            stack.extend(reversed(x.children))
    return " ".join(out)


def published_identities(pages: DataFrame, mirror: str, html: str, required: str, version: str, text: str) -> DataFrame:
    """(mirror, least_version, most_version, version_agrees, text_found) of pages.

    version_agrees: pages declare this version and no other; none declared does not agree. text_found: a page whose column `required` is true shows text.
    Facts are gathered before the shuffle, so a large mirror is no hot key.
    """

    def facts(page: str | None, is_required: bool | None) -> dict:
        root = parse(page)
        versions = declared_versions(root)
        return {"least": min(versions, default=None), "most": max(versions, default=None), "found": bool(is_required) and text in visible_words(root)}

    kind = pa.struct([("least", pa.string()), ("most", pa.string()), ("found", pa.bool_())])
    found = map_pages(pages, mirror, [html, required], facts, "facts", kind, "struct<least:string,most:string,found:boolean>")
    least, most = F.min("facts.least"), F.max("facts.most")
    agrees = F.coalesce((least == version) & (most == version), F.lit(False))
    return found.groupBy(mirror).agg(least.alias("least_version"), most.alias("most_version"), agrees.alias("version_agrees"), F.max("facts.found").alias("text_found"))
