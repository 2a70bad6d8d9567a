"""Markdown: sections, links and marked-up hints."""

from __future__ import annotations

import re

HEADING = re.compile(r"^ {0,3}#{1,6}(?:\s|$)")
FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^\s<>()]*(?:\([^\s()]*\)[^\s()]*)*)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
KINDS = ["hint", "background", "reminder", "warning", "example"]
MARKER = re.compile(r"\{\{(" + "|".join(KINDS) + "):")


def _lines(markdown: str):
    """(offset, line, fenced) for each line."""
    at, fence = 0, None
    for line in markdown.splitlines(keepends=True):
        m = FENCE.match(line)
        inside = fence is not None
        if m and (fence is None or (m[1][0] == fence[0] and len(m[1]) >= len(fence))):
            fence = m[1] if fence is None else None
            inside = True
        yield at, line, inside
        at += len(line)


def sections(markdown: str | None) -> list[str]:
    """Cut before every heading outside fences; joined again they are the text."""
    text = markdown or ""
    cuts = [at for at, line, fenced in _lines(text) if not fenced and HEADING.match(line)]
    bounds = [0, *(c for c in cuts if c > 0), len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]


def citations(markdown: str | None) -> list[tuple[int, str, str]]:
    """(position, text, url) of links, not of images, outside fences; mail, phone and script links are none."""
    out = []
    for at, line, fenced in _lines(markdown or ""):
        for m in () if fenced else LINK.finditer(line):
            url = m[3].strip()
            if not m[1] and url and not re.match(r"(?i)(mailto|tel|javascript):", url):
                out.append((at + m.start(), m[2], url))
    return out


def hints(markdown: str | None) -> list[tuple[str, str, int]]:
    """(kind, text, position) of {{kind:text}} outside fences and inline code. The end is the last two braces of a run; blank ones are dropped, open ones are plain text."""
    text, out = markdown or "", []
    plain = bytearray(len(text))
    for at, line, fenced in _lines(text):
        code = fenced
        for i, c in enumerate(line):
            if c == "`" and not fenced:
                code = not code
            plain[at + i] = not code
    at = 0
    while m := MARKER.search(text, at):
        at = m.end()
        if not plain[m.start()]:
            continue
        end = re.search(r"\}{2,}", text[m.end() :])
        if end is None:
            break
        stop = m.end() + end.end() - 2
        said = text[m.end() : stop].strip()
        if said:
            out.append((m[1], said, m.start()))
        at = stop + 2
    return out


def without_reference_marks(markdown: str) -> str:
    """Without [1], [2] ... that are no links, outside fences."""
    return "".join(line if fenced else re.sub(r" ?\[\d{1,3}\](?!\(|:)", "", line) for _, line, fenced in _lines(markdown))
