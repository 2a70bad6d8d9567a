"""Questions as columns, the index of predicates, and answers, against plain Python and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import dense, retrieval
from docloom.plans import query_parse, questions, scopes

ASKED = [
    "Java 21 and 25?", "java se 8, 21 & 24 vs. 17", "JDK-24 + 25/21 versus 3", "javascript 21, java21", "Java 99 and 98 and 21", "jdk 17, java 21", "java 211", "", None, "Java\n21,\n24",
    "What does List.of(E, E) return?", "java.util.Map.entry(K,V)", "List::of", "List.of(x).stream()", "a.b.Outer.Inner.get()", "List.of() and Set.of(E...)", "Stream.<T>of", "Stream.map <R>", "x.List.of", "java.util.List.class",
    "String.valueOf(char[])", "String.valueOf( char [ ] )", "Foo.bar(java.util.List, int...)", "Foo.bar(java . util . List)", "Foo.bar(name)", "Foo.bar(List)", "Foo.bar(List<E>)", "Foo.bar(E,)", "Foo.bar(", "Foo.bar((E))", "See Foo.bar, Foo.baz", "1Foo.bar", "é Foo.bar(int) é", "Foo.$x(_a.B)", "com.Foo.com", "List.of(Map.entry(K, V))",
]


def plain_members(x):
    return [(m.package, m.type, m.method, m.signature) for m in query_parse.members(x)]


def test_questions_as_columns_equal_plain_parsing(spark):
    rng, parts = random.Random(5), ["Java ", "jdk", "JDK-", "21", "24", " and ", ", ", "&", "vs.", "25", "List", ".", "of", "::", "(", ")", "E", ",", " ", "java.util.", "Map", "[]", "...", "<", "int", "$", "x"]
    asked = ASKED + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, text string").withColumn("v", questions.requested_versions(F.col("text"), ["21", "24", "25"])).withColumn("m", questions.members(F.col("text")))
    for r in rows.withColumn("b", questions.boosted(F.col("text"), F.col("v"))).collect():
        versions = query_parse.requested_versions(asked[r.id], ["21", "24", "25"])
        assert (r.v, [tuple(m) for m in r.m]) == (versions, plain_members(asked[r.id])), asked[r.id]
        assert r.b == (asked[r.id] and query_parse.boosted(asked[r.id], versions) if asked[r.id] is not None or versions else None)


def test_scopes_against_all_pairs(spark):
    rng, fields = random.Random(2), ["a", "b", "c"]
    some = lambda: [rng.choice("xyz") for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    asked = [(i, i % 5, some(), some(), rng.choice([None, []]) if i % 3 else some()) for i in range(60)]
    points = [(i, i % 5, *(rng.choice(["x", "y", "z", None]) for _ in fields)) for i in range(120)]
    s = spark.createDataFrame(asked, "scope int, q int, a array<string>, b array<string>, c array<string>")
    p = spark.createDataFrame(points, "id int, q int, a string, b string, c string")
    lies = lambda x, y: all(not y[k] or x[k] in y[k] for k in (2, 3, 4))
    found = scopes.in_scopes(p.drop("q"), s.drop("q"), fields, ["scope"])
    assert sorted((r.id, r.scope) for r in found.collect()) == sorted((x[0], y[0]) for x in points for y in asked if lies(x, y))
    own = scopes.in_scopes(p, s, fields, ["scope"], by=["q"])
    assert sorted((r.id, r.scope) for r in own.collect()) == sorted((x[0], y[0]) for x in points for y in asked if x[1] == y[1] and lies(x, y))
    assert scopes.in_scopes(p.drop("q"), s.drop("q").limit(0), fields, ["scope"]).count() == 0
    # The plan does not grow with the scopes.
    text = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    many = s.drop("q").unionByName(s.drop("q").withColumn("scope", F.col("scope") + 1000))
    assert text(scopes.in_scopes(p.drop("q"), many, fields, ["scope"])) < text(found) + 0.1 * text(found) + 3000


def test_dense_search_within_scopes(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], [int(q) for q in range(6) if rng.random() < 0.4] if i % 9 else None) for i in range(200)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, inside array<long>")
    asked = table.where("vec_id < 6")
    unit = np.array([v for _, v, _ in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = sorted((r.query, r["rank"], r.vec_id) for r in dense.dense_top_k(table, asked, 5, inside="inside").collect())
    want = []
    for q in range(6):
        near = sorted((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i, _, allowed in vectors if allowed and q in allowed)
        want += [(q, n + 1, i) for n, (_, i) in enumerate(near[:5])]
    assert found == want


def page(package, name):
    return f"/en/java/{package.replace('.', '/')}/{name}"


def order(spark, question, entries, member=None):
    """ids in citation order. entries: (id, text, url package, page, doc type, type page, package, anchor)."""
    first = query_parse.members(question)
    shape = "struct<package:string,type:string,method:string,signature:string>"
    row = lambda m: m and (m.package, m.type, m.method, m.signature)
    data = [("q", 0, n, e[0], e[1], page(e[2], e[3]) if e[2] else f"/{e[3]}", e[2], e[4], e[5], e[6], e[7], row(first[0]) if first else None, member) for n, e in enumerate(entries)]
    table = spark.createDataFrame(data, f"query string, scope int, rank int, id string, text string, url_path string, url_package string, doc_type string, type_page string, package string, anchor string, first_member {shape}, member {shape}")
    return [r.id for r in retrieval.in_citation_order(table).orderBy("order").collect()]


def entry(name, text, package="java.util", on="List.html", kind="api-docs", type_page=None, stored=None, anchor=None):
    return name, text, package, on, kind, type_page, stored, anchor


def test_citation_order(spark):
    of = "static <E> List<E> of(E element)"
    listed, other = entry("list", of), entry("other", "factory of()", on="Other.html")
    assert order(spark, "What does List.of return?", [other, listed, entry("page", "none here")]) == ["list", "page", "other"]
    assert order(spark, "How do lists work?", [other, listed]) == ["other", "list"]
    assert order(spark, "Compare List.of(E) with Set.of(E)", [entry("set", of, on="Set.html"), listed]) == ["list", "set"]
    assert order(spark, "List.of(value)", [entry("a", of), entry("b", of)]) == ["a", "b"]
    # A page below another package, one without a package, one of another kind.
    assert order(spark, "List.of", [entry("use", of, package="java.util.class-use"), entry("root", of, package=""), listed]) == ["list", "use", "root"] or order(spark, "List.of", [entry("root", of, package=""), listed]) == ["list", "root"]
    assert order(spark, "List.of", [entry("guide", of, kind="guide"), entry("none", of, kind=None), other]) == ["other", "guide", "none"]
    assert order(spark, "java.util.Date.toString", [entry("sql", "String toString()", "java.sql", "Date.html"), entry("util", "String toString()", "java.util", "Date.html")]) == ["util", "sql"]
    assert order(spark, "List.of", [entry("upper", "Of()", on="X.html"), entry("longer", "sumof() ofx() of", on="X.html"), entry("spaced", "of \n(", on="X.html"), entry("letter", "éof()", on="X.html")]) == ["spaced", "upper", "longer", "letter"]


def test_own_entries(spark):
    some = [entry("e", "", type_page="List.html", stored="java.util", anchor="of(E)"), entry("ee", "", type_page="List.html", stored="java.util", anchor="of(E,E)"), entry("copy", "", type_page="List.html", stored="java.util", anchor="copyOf(E)"), entry("set", "", type_page="Set.html", stored="java.util", anchor="of(E,E)"), entry("sql", "", type_page="List.html", stored="x.y", anchor="of(E,E)"), entry("pdf", "", kind="pdf", type_page="List.html", stored="java.util", anchor="of(E,E)"), entry("bare", "", type_page="List.html", stored="java.util"), entry("noargs", "", type_page="List.html", stored="java.util", anchor="of")]
    assert order(spark, "List.of(E, E)", some, ("java.util", "List", "of", "(E,E)")) == ["ee"]
    assert order(spark, "List.of(K)", some, ("java.util", "List", "of", "(K)")) == []
    assert order(spark, "List::of", some, ("java.util", "List", "of", None)) == ["e", "ee"]


def test_releases_are_covered_or_named(spark):
    rows = [(q, n, i, v, 1.0) for q in ("a", "b", "c", "d", "e") for n, (i, v) in enumerate([(0, "21"), (1, "21"), (2, "x"), (3, "24"), (4, "25")])]
    found = spark.createDataFrame(rows, "query string, order int, doc_id long, version string, score double")
    asked = [("a", ["21", "24"]), ("b", []), ("c", ["25", "24", "21"]), ("d", ["17"]), ("e", ["21", "24", "25", "x"]), ("f", ["21"]), ("g", [])]
    asked = spark.createDataFrame([(q, v, "hybrid", None, "said before" if q == "g" else None) for q, v in asked], "query string, requested array<string>, path string, member string, failure string")
    out = {r.query: ([x.doc_id for x in r.rows], r.failure) for r in retrieval.answers(asked, found, "doc_id", 3).collect()}
    assert out == {"a": ([0, 1, 3], None), "b": ([0, 1, 2], None), "c": ([0, 3, 4], None), "d": ([], retrieval.NO_RELEASE + "17"), "e": ([], retrieval.NO_ROOM), "f": ([], retrieval.NO_RELEASE + "21"), "g": ([], "said before")} or out["c"][0] == [0, 4, 3]
    with pytest.raises(Exception, match="release 17"):
        retrieval.require_answers(retrieval.answers(asked, found, "doc_id", 3)).collect()


def test_constraints_of_questions(spark):
    sets = {"21": "j21", "24": "j24", "25": "j25"}
    every = ["j21", "j24", "j25", "books"]
    rows = [
        (1, "How do lists work?", None, every, "official"),
        (2, "How do lists work?", None, every, "other"),
        (3, "Java 24 lists", None, ["j24", "books"], None),
        (4, "Java 24 and 21 lists", None, ["j24", "books"], None),
        (5, "Java 24 lists", ["21"], [], None),
        (6, "Java 24 and 21", ["21"], [], None),
        (7, "List.of(E)", None, every, "official"),
        (8, "java.sql.Date.of(E)", None, every, "official"),
        (9, "Date.of(E)", None, every, ""),
        (10, "List.of", None, ["books"], ""),
        (11, "  ", None, None, None),
        (12, "Two.of", [" 21", "21", ""], ["j21"], ""),
    ]
    table = spark.createDataFrame([(*r, None, None) for r in rows], "query int, text string, doc_versions array<string>, doc_sets array<string>, source_kind string, doc_type string, source_name string")
    platform = spark.createDataFrame([("java.util", "List", "of"), ("java.sql", "Date", "of"), ("java.util", "Date", "of"), ("java.lang", "Two", "of")], "package string, type string, method string")
    asked = retrieval.plan_questions(table, platform, sets)
    found = {r.query: r for r in asked.collect()}
    assert 11 not in found and found[1].doc_sets == ["j25", "books"] and found[2].doc_sets == every
    assert (found[3].requested, found[4].requested, found[4].doc_versions) == (["24"], ["24"], ["24"])
    assert found[5].failure == found[6].failure == retrieval.CONFLICT
    assert (found[7].path, found[7].exact, found[7].doc_sets, found[7].member.package, found[7].search_text) == ("member", True, every, "java.util", "List of")
    assert found[8].member.package == "java.sql" and found[9].member is None and found[9].path == "hybrid"
    assert (found[10].path, found[12].path, found[12].exact, found[12].doc_versions) == ("hybrid", "member", False, ["21"])
    scoped = {(r.query, r.scope): r for r in retrieval.question_scopes(asked).collect()}
    assert {q for q, _ in scoped} == {1, 2, 3, 4, 7, 8, 9, 10, 12}
    assert (scoped[7, 0].anchor, scoped[7, 0].type_page, scoped[7, 0].collection, scoped[12, 0].collection, scoped[1, 0].collection) == (["of(E)"], ["List.html"], ["docs"], ["docs", "pdfs"], [])
