"""What a question asks for: releases, API members and signatures."""

from __future__ import annotations

import re
from dataclasses import dataclass

# How a release is named, and how further ones follow.
EXPLICIT = re.compile(r"\b(?:java\s*se|javase|java|jdk)[\s-]*(\d{1,2})\b", re.IGNORECASE)
FOLLOWING = re.compile(r"\s*(?:,|and\b|vs(?:\.|\b)|versus\b|\+|/|&)\s*(\d{1,2})\b", re.IGNORECASE)
PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short"}
#: Last names of a dotted chain that are no methods.
NO_METHODS = {"class", "this", "super", "new", "html", "java", "com", "org", "net", "io"}

MEMBER = re.compile(r"(?<![\w$.])((?:[a-z_$][\w$]*\.)*)((?:[A-Z][\w$]*)(?:\.[A-Z][\w$]*)*)(?:\.|::)([a-z_$][\w$]*)(?![\w$])")
NAME = re.compile(r"(?:[a-z_$][\w$]*\.)*[A-Z][\w$]*(?:\.[A-Z][\w$]*)*")


def requested_versions(query: str | None, supported: list[str]) -> list[str]:
    """Named releases in order, each once; those that only follow another one's name count if they are supported."""
    out: list[str] = []
    for m in EXPLICIT.finditer(query or ""):
        out.append(m[1])
        at = m.end()
        while (n := FOLLOWING.match(query, at)) and n[1] in supported:
            out.append(n[1])
            at = n.end()
    return list(dict.fromkeys(out))


def boosted(query: str, versions: list[str]) -> str:
    named = "; ".join(f"JDK {v} Java SE {v} Java {v} release documentation" for v in versions)
    return f"{named}: {query}" if versions else query


def invocation_signature(text: str) -> str | None:
    """The parameter list at the start of text without blanks, if every parameter is a type: a primitive, a type variable or a dotted name."""
    m = re.match(r"\s*\(([^()]*)\)", text)
    if not m:
        return None
    inner = m[1].strip()
    if not inner:
        return "()"
    out = []
    for part in inner.split(","):
        bare = re.sub(r"\s*\.\s*(?=[A-Za-z_$])", ".", part.strip())
        bare = re.sub(r"\s*\[\s*\]", "[]", bare)
        bare = re.sub(r"\s*\.\.\.$", "...", bare)
        base = re.sub(r"(\[\])*(\.\.\.)?$", "", bare)
        dotted = "." in base and NAME.fullmatch(base) and base[0].islower()
        if not (base in PRIMITIVES or re.fullmatch("[A-Z]", base) or dotted):
            return None
        out.append(bare)
    return f"({','.join(out)})"


@dataclass(frozen=True)
class Member:
    package: str
    type: str
    method: str
    signature: str | None

    @property
    def terms(self) -> str:
        return f"{self.type.replace('.', ' ')} {self.method}"

    def page_matches(self, path: str, package: str | None = None) -> bool:
        """Whether a page's path ends with the type's page, below the package if one is known."""
        package = package if package is not None else self.package
        place = "/".join([*(package.split(".") if package else []), f"{self.type}.html"])
        return path.endswith(f"/{place}") or path == place

    def anchor_matches(self, anchor: str) -> bool:
        return anchor.split("(", 1)[0] == self.method

    def declared_in(self, text: str) -> bool:
        return re.search(rf"(?<![\w$]){re.escape(self.method)}(?![\w$])\s*\(", text) is not None


def members(query: str | None) -> list[Member]:
    """Type.method, pkg.Type.method and Type::method in order. A chained or generic call names none."""
    out = []
    for m in MEMBER.finditer(query or ""):
        after = query[m.end() :]
        if m[3] in NO_METHODS or after.lstrip().startswith("<"):
            continue
        call = re.match(r"\s*\([^()]*\)", after)
        if call and re.match(r"\s*\.\s*[A-Za-z_$]", after[call.end() :]):
            continue
        out.append(Member(m[1].rstrip("."), m[2], m[3], invocation_signature(after)))
    return out


def unique_member(query: str | None) -> Member | None:
    found = members(query)
    return found[0] if len(found) == 1 else None


def citation_query(query: str) -> str:
    """What is looked for lexically: a unique member's names alone, those of several after the question."""
    found = members(query)
    if len(found) == 1:
        return found[0].terms
    return " ".join([query, *(m.terms for m in found)]) if found else query


def exact_anchor(member: Member) -> str | None:
    return f"{member.method}{member.signature}" if member.signature is not None else None
