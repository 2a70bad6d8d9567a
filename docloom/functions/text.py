"""Text functions: case folding, cleaning, sizes, scores and cuts. All stay in the JVM; none fails on null or empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ELLIPSIS = "…"
# Characters that show nothing beside white space: zero-width ones, joiners, byte-order mark and soft hyphen.
INVISIBLE = r"\s\p{Z}​‌‍⁠﻿­"

# What joins letters, digits, both, and whatever it stands between, by the standard's word-break properties (UAX #29).
MID_LETTER = r":··՟״‧︓﹕："
MID_NUMBER = r",;;։،؍٬߸⁄︐︔﹐﹔，；"
MID_BOTH = r".'‘’․﹒＇．"
CONNECTOR = r"[\p{Pc} ]"
#: Letters without spaces between words: ideographs and Hiragana are words one by one, the others in runs.
SINGLE, RUNS = r"\p{IsHan}\p{IsHiragana}", r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
KATAKANA = r"\p{IsKatakana}〱-〵゛゜゠ーｰ"


def _word_pattern() -> str:
    # Combining marks and format characters belong to what is before them. Possessive where it can be, so that nothing that matched is tried again.
    marks = r"[\p{M}\p{Cf}&&[^​]]*+"
    letter = rf"[\p{{L}}\p{{Nl}}&&[^{SINGLE}{RUNS}{KATAKANA}]]{marks}"
    digit, link = rf"[\p{{Nd}}٫]{marks}", rf"{CONNECTOR}{marks}"
    letters = rf"{letter}(?:(?:[{MID_LETTER}{MID_BOTH}]{marks})?{letter})*+"
    digits = rf"{digit}(?:(?:[{MID_NUMBER}{MID_BOTH}]{marks})?{digit})*+"
    part = rf"(?:(?:{letters}|{digits})++|(?:[{KATAKANA}]{marks})++)"
    return rf"(?:{link})*+{part}(?:(?:{link})++{part})*+(?:{link})*+|[{SINGLE}]{marks}|(?:[{RUNS}]{marks})++"


def words(x: Column) -> Column:
    """The words of a text by the Unicode standard's word breaks: don't, 3.14 and a_b are one, ideographs are words one by one. Emoji are none."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(_word_pattern()), F.lit(0))


def ascii_lower(x: Column) -> Column:
    """A-Z only; null is empty."""
    return F.translate(F.coalesce(x, F.lit("")), UPPER, UPPER.lower())


def normalized_token(x: Column) -> Column:
    """Trimmed and lower-cased; null is empty."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))


def drop_control_characters(x: Column) -> Column:
    """Without ISO control characters but line feed, carriage return and tab."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def has_visible_content(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(f"[^{INVISIBLE}]")


def estimated_tokens(x: Column) -> Column:
    """A quarter of the characters plus one; 0 for no text."""
    n = F.length(F.coalesce(x, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.floor(n / 4) + 1).cast("long")


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    n = F.length(needle)
    return F.when(n > 0, (F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / n).otherwise(0).cast("long")


def keyword_score(text: Column, words: Column) -> Column:
    """Occurrences of all query words over the text's length, of 50 characters at least."""

    def score(t: Column) -> Column:
        hits = F.aggregate(F.transform(words, lambda w: occurrences(t, w)), F.lit(0).cast("long"), lambda a, x: a + x)
        return hits / F.greatest(F.lit(50), F.length(t))

    # The text is bound once: an expression that stands for it, such as a translation, is not made again for each word.
    return F.get(F.transform(F.array(text), score), F.lit(0))


def first_number(x: Column) -> Column:
    """The first run of digits, empty if none."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), "([0-9]+)", 1)


def cut_with_ellipsis(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(ELLIPSIS))).otherwise(x)


def failure_details(x: Column, most: int = 240) -> Column:
    """On one line (each line end is a blank), cut with three dots."""
    flat = F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "\r\n", "  "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def truncated(x: Column, tokens: int, notice: str = "\n[...content truncated for token limits...]") -> Column:
    """(text, truncated, original_length): cut at four characters a token, back to the last full stop or line end if that is in the last fifth."""
    most = tokens * 4
    head = F.substring(x, 1, most)
    mirrored = F.reverse(head)
    from_end = F.least(*(F.when(F.locate(c, mirrored) > 0, F.locate(c, mirrored)).otherwise(most + 1) for c in (".", "\n")))
    place = F.lit(most) - from_end  # counted from 0
    cut = F.when(place > int(most * 0.8), F.substring(head, F.lit(1), place + 1)).otherwise(head)
    over = F.length(x) > most
    return F.struct(F.when(over, F.concat(cut, F.lit(notice))).otherwise(x).alias("text"), over.alias("truncated"), F.length(x).alias("original_length"))


def trimmed_distinct(tokens: Column) -> Column:
    """Trimmed tokens without blanks and repeats, in their order."""
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != ""))


def trimmed_filled(tokens: Column) -> Column:
    """Trimmed tokens without blanks; null is empty."""
    return F.filter(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
