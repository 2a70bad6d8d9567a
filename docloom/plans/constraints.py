"""Retrieval constraints: what a query may search, as a record that compiles to a column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLECTIONS = ["books", "docs", "articles", "pdfs"]


def tokens(values: list[str | None]) -> list[str]:
    """Trimmed, without blanks and repeats, in order."""
    return list(dict.fromkeys(t for v in values if (t := (v or "").strip())))


@dataclass(frozen=True)
class Constraint:
    """Every part that is set must hold; none set allows everything."""

    doc_versions: list[str] = field(default_factory=list)
    source_kind: str = ""
    doc_type: str = ""
    source_name: str = ""
    doc_sets: list[str] = field(default_factory=list)

    def __post_init__(self):
        object.__setattr__(self, "doc_versions", tokens(self.doc_versions))
        object.__setattr__(self, "doc_sets", tokens(self.doc_sets))
        for name in ("source_kind", "doc_type", "source_name"):
            object.__setattr__(self, name, (getattr(self, name) or "").strip())

    def condition(self, version: str = "doc_version", source_kind: str = "source_kind", doc_type: str = "doc_type", source_name: str = "source_name", doc_set: str = "doc_set") -> Column:
        """On plain columns, so that it reaches the scan."""
        out = F.lit(True)
        for column, values in ((version, self.doc_versions), (source_kind, [self.source_kind]), (doc_type, [self.doc_type]), (source_name, [self.source_name]), (doc_set, self.doc_sets)):
            if any(values):
                out = out & F.col(column).isin(values)
        return out

    def with_doc_versions(self, required: list[str]) -> Constraint:
        """Only the required versions, in their order, that this constraint allows; none left is an error."""
        wanted = [v for v in tokens(required) if not self.doc_versions or v in self.doc_versions]
        if not wanted:
            raise ValueError(f"no requested version of {required} is in scope")
        return replace(self, doc_versions=wanted)

    def with_doc_sets(self, doc_sets: list[str]) -> Constraint:
        return replace(self, doc_sets=doc_sets)

    def collections(self, official: set[str], discovered: list[str]) -> list[str]:
        """Official documents alone are in docs and pdfs; anything else may be anywhere."""
        if self.doc_sets and set(self.doc_sets) <= official:
            return ["docs", "pdfs"]
        return [*COLLECTIONS, *discovered]

    def applicable_versions(self, requested: list[str], doc_set_of: dict[str, str]) -> list[str]:
        """Requested versions whose doc set is in scope; all if no doc set is named."""
        return [v for v in requested if not self.doc_sets or doc_set_of.get(v) in self.doc_sets]

    def newest_api_only(self, requested: list[str], api_sets: dict[str, str], exact_overload: bool = False) -> Constraint:
        """Without a requested version or an exact overload, the older of several API doc sets in scope are left out."""
        present = [s for s in api_sets.values() if s in self.doc_sets]
        if requested or exact_overload or len(present) < 2:
            return self
        newest = api_sets[max((v for v, s in api_sets.items() if s in present), key=int)]
        return replace(self, doc_sets=[s for s in self.doc_sets if s not in present or s == newest])


def require_evidence(rows: list, what: str) -> list:
    """The rows; no rows are an error, never silently an empty answer."""
    if not rows:
        raise LookupError(f"no evidence for {what}")
    return rows
