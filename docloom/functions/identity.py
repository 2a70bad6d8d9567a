"""Content-derived identities: hashes, ids, file-safe names, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_length

# Fixed value: the version that member hashes begin with.
MEMBER_HASH_VERSION = "java-api-member-chunk-v2"


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def chunk_hash(url: Column, index: Column, text: Column) -> Column:
    return sha256(F.concat(url, F.lit("#"), index.cast("string"), F.lit(":"), text))


def member_chunk_hash(url: Column, index: Column, anchor: Column, text: Column) -> Column:
    """Of a page member's chunk. Lengths, in UTF-16 units, keep fields apart."""
    fields = [F.lit(MEMBER_HASH_VERSION), utf16_length(url).cast("string"), url, index.cast("string"), utf16_length(anchor).cast("string"), anchor, utf16_length(text).cast("string"), text]
    return sha256(F.concat_ws("\0", *fields))


def uuid_from_hash(x: Column) -> Column:
    """A version 3 UUID from the MD5 of the hash string's bytes, without a namespace."""
    m = F.md5(x)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.conv(F.substring(m, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"), variant, F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))


def safe_name(url: Column) -> Column:
    """A file name: other characters become _, and over 150 characters the middle becomes part of a hash of the URL."""
    plain = F.regexp_replace(url, r"[^a-zA-Z0-9._-]", "_")
    short = F.concat(F.substring(plain, 1, 80), F.lit("_"), F.substring(sha256(url), 1, 12), F.lit("_"), F.right(plain, F.lit(40)))
    return F.when(F.length(plain) > 150, short).otherwise(plain)


def base64_of(x: Column) -> Column:
    """Padded, on one line."""
    return F.regexp_replace(F.base64(F.encode(F.coalesce(x, F.lit("")), "UTF-8")), r"[\r\n]", "")


def base64_url_of(x: Column) -> Column:
    """URL alphabet, without padding."""
    return F.translate(base64_of(x), "+/=", "-_")


def provenance_fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields in base64, so that no separator within a field can shift another."""
    return sha256(F.concat_ws(".", *map(base64_url_of, fields)))


def marker_payload(title: Column, package: Column) -> Column:
    trimmed = lambda x: base64_of(F.trim(F.coalesce(x, F.lit(""))))
    return F.concat(F.lit("1\ntitleB64="), trimmed(title), F.lit("\npackageB64="), trimmed(package), F.lit("\n"))


def marker_fields(payload: Column) -> Column:
    """(title, package) of marker_payload."""
    field = lambda name: F.decode(F.unbase64(F.regexp_extract(payload, f"(?m)^{name}=(.*)$", 1)), "UTF-8")
    return F.struct(field("titleB64").alias("title"), field("packageB64").alias("package"))
