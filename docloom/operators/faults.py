"""Failures of services by category, and what is said of a search's quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of categories, in the order in which a message is tried, with the words of which one must stand in it.
NOT_FOUND, UNAUTHORIZED, FORBIDDEN, RATE_LIMITED = "404 Not Found", "401 Unauthorized", "403 Forbidden", "429 Rate Limited"
CONNECTION, EMBEDDING, UNKNOWN = "Connection Error", "Embedding Service Unavailable", "Unknown Error"
WORDS = {NOT_FOUND: ["404", "not found"], UNAUTHORIZED: ["401", "unauthorized"], FORBIDDEN: ["403", "forbidden"], RATE_LIMITED: ["429", "too many requests"]}
EMBEDDING_WORDS = ["unavailable", "unreachable", "provider"]
# Status codes of a vector store that are connection errors, and those of a collection's failure that pass.
CONNECTION_STATUS = ["DEADLINE_EXCEEDED", "UNAVAILABLE"]
TRANSIENT_STATUS = ["ABORTED", "DEADLINE_EXCEEDED", "INTERNAL", "RESOURCE_EXHAUSTED", "UNAVAILABLE"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def error_category(status: Column, message: Column, timed_out: Column) -> Column:
    """A failure's label. A status code decides alone; without one the messages do, and a timeout only if they name no HTTP failure."""
    said = F.lower(F.coalesce(message, F.lit("")))
    by_status = F.when(status.isin(CONNECTION_STATUS), CONNECTION).otherwise(UNKNOWN)
    out = F.when(status.isNotNull(), by_status)
    for label, words in WORDS.items():
        out = out.when(_any(said, words), label)
    out = out.when(F.coalesce(timed_out, F.lit(False)) | said.contains("connection"), CONNECTION)
    return out.when(said.contains("embedding") & _any(said, EMBEDDING_WORDS), EMBEDDING).otherwise(UNKNOWN)


def is_retryable(category: Column) -> Column:
    """Whether a call that failed so is tried again."""
    return category.isin(RATE_LIMITED, CONNECTION)


def disposition(status: Column, timed_out: Column) -> Column:
    """TRANSIENT or PERMANENT, by timeout and status code alone; no code is permanent."""
    return F.when(F.coalesce(timed_out, F.lit(False)) | F.coalesce(status.isin(TRANSIENT_STATUS), F.lit(False)), "TRANSIENT").otherwise("PERMANENT")


# What is said of each level; {n} results, {high} of them of high quality.
NOTES = {
    "NONE": "No relevant documents found. Using general knowledge only.",
    "KEYWORD_SEARCH": "Found {n} documents via keyword search (embedding service unavailable). Results may be less semantically relevant.",
    "HIGH_QUALITY": "Found {n} high-quality relevant documents via semantic search.",
    "MIXED_QUALITY": "Found {n} documents ({high} high-quality) via search. Some results may be less relevant.",
}


def search_note(level: Column, results: Column, high: Column) -> Column:
    """The note for a level of operators.quality.search_quality."""
    out = F.when(F.lit(False), F.lit(""))
    for name, note in NOTES.items():
        said = F.replace(F.lit(note), F.lit("{n}"), results.cast("string"))
        out = out.when(level == name, F.replace(said, F.lit("{high}"), high.cast("string")))
    return out


def noted_prompt(core: Column, note: Column, low_quality: Column) -> Column:
    """The system prompt with the note after a blank line, and with the prompt for weak results if the note speaks of less relevant ones or of keyword search."""
    weak = note.contains("less relevant") | note.contains("keyword search")
    return F.when(note == "", core).otherwise(F.concat(core, F.lit("\n\nSEARCH CONTEXT: "), note, F.when(weak, F.concat(F.lit("\n"), low_quality)).otherwise("")))
