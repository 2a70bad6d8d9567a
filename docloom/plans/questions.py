"""What questions ask for, as columns: releases, members of an API and their signatures. One plan for a table of any number of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query_parse import NO_METHODS, PRIMITIVES

# How a release is named, and how further ones follow.
RELEASES = r"(?i)\b(?:java\s*se|javase|java|jdk)[\s-]*(\d{1,2}\b(?:\s*(?:,|and\b|vs(?:\.|\b)|versus\b|\+|/|&)\s*\d{1,2}\b)*)"
#: Type.method, pkg.Type.method or Type::method that is neither generic nor chained; the fourth group is its argument list.
MEMBER = r"(?<![\w$.])((?:[a-z_$][\w$]*\.)*)((?:[A-Z][\w$]*)(?:\.[A-Z][\w$]*)*)(?:\.|::)([a-z_$][\w$]*)(?![\w$])(?!\s*<)(?!\s*\([^()]*\)\s*\.\s*[A-Za-z_$])(?=(\s*\([^()]*\))?)"
QUALIFIED = r"^(?=[a-z])(?:[a-z_$][\w$]*\.)+[A-Z][\w$]*(?:\.[A-Z][\w$]*)*$"


def requested_versions(question: Column, supported: list[str]) -> Column:
    """Named releases in order, each once; those that only follow another one's name count up to the first that is not supported."""

    def own(chain: Column) -> Column:
        numbers = F.regexp_extract_all(chain, F.lit(r"\d{1,2}"), F.lit(0))
        rest = F.slice(numbers, 2, F.size(numbers))
        stop = F.array_position(F.transform(rest, lambda n: ~n.isin(supported)), True)
        return F.when(stop > 0, F.slice(numbers, F.lit(1), stop.cast("int"))).otherwise(numbers)

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(RELEASES), F.lit(1)), own)))


def signature(arguments: Column) -> Column:
    """The parameter list without blanks, if every parameter is a type: a primitive, a type variable or a dotted name; else null."""
    inner = _strip(F.regexp_extract(arguments, r"^\s*\(([^()]*)\)", 1))

    def parameter(x: Column) -> Column:
        x = F.regexp_replace(_strip(x), r"\s*\.\s*(?=[A-Za-z_$])", ".")
        return F.regexp_replace(F.regexp_replace(x, r"\s*\[\s*\]", "[]"), r"\s*\.\.\.$", "...")

    def is_type(x: Column) -> Column:
        base = F.regexp_replace(x, r"(\[\])*(\.\.\.)?$", "")
        return base.isin(*sorted(PRIMITIVES)) | base.rlike("^[A-Z]$") | base.rlike(QUALIFIED)

    parts = F.transform(F.split(inner, ",", -1), parameter)
    return F.when(arguments == "", None).when(inner == "", "()").when(F.forall(parts, is_type), F.concat(F.lit("("), F.array_join(parts, ","), F.lit(")")))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def members(question: Column) -> Column:
    """array of (package, type, method, signature), in order."""
    text = F.coalesce(question, F.lit(""))
    groups = [F.regexp_extract_all(text, F.lit(MEMBER), F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.filter(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "ptma"))), lambda x: ~x["m"].isin(*sorted(NO_METHODS)))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(x["p"], r"\.$", "").alias("package"), x["t"].alias("type"), x["m"].alias("method"), signature(x["a"]).alias("signature")))


def boosted(question: Column, versions: Column) -> Column:
    """The question behind the names of its releases."""
    named = F.array_join(F.transform(versions, lambda v: F.concat(F.lit("JDK "), v, F.lit(" Java SE "), v, F.lit(" Java "), v, F.lit(" release documentation"))), "; ")
    return F.when(F.size(versions) > 0, F.concat(named, F.lit(": "), question)).otherwise(question)
