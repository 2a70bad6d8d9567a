import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import html, identity, markdown, murmur, strict_json, text, urls
from docloom.operators import sparse
from docloom.plans import query_parse
from docloom.plans.constraints import Constraint, require_evidence
from docloom.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_uuid_of_a_hash(spark):
    assert value(spark, identity.uuid_from_hash(F.lit("ab" * 32))) == "28cd7344-7ffe-3d99-92a2-edbbb90742dd"
    x = hashlib.sha256(b"x").hexdigest()
    assert value(spark, identity.uuid_from_hash(F.lit(x))) == str(uuid.UUID(bytes=hashlib.md5(x.encode()).digest(), version=3))


def test_murmur_vectors():
    assert murmur.murmur3(["hello", "", "java"], 0).tolist()[:2] == [0x248BFA47, 0]
    assert murmur.murmur3(["hello"], 42).tolist() == [3806057185]


@given(st.text(max_size=40))
@settings(max_examples=50, deadline=None)
def test_murmur_of_a_batch_is_that_of_each(x):
    assert murmur.murmur3([x, x + "y", "a"]).tolist() == [murmur.murmur3([t])[0] for t in (x, x + "y", "a")]


def test_text_functions_on_nulls_and_edges(spark):
    assert value(spark, text.ascii_lower(F.lit("ÀB"))) == "Àb" and value(spark, text.ascii_lower(F.lit(None).cast("string"))) == ""
    assert [value(spark, text.estimated_tokens(F.lit(x))) for x in ("", "abc", "abcd", "a" * 8)] == [0, 1, 2, 3]
    assert value(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert not value(spark, text.has_visible_content(F.lit(" ​\n "))) and value(spark, text.has_visible_content(F.lit(" x")))
    assert value(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and value(spark, text.occurrences(F.lit("aa"), F.lit(""))) == 0
    cut = value(spark, text.truncated(F.lit("a" * 35 + "." + "b" * 20), 10))
    assert cut.text == "a" * 35 + ".\n[...content truncated for token limits...]" and cut.truncated and cut.original_length == 56
    assert value(spark, text.truncated(F.lit("short"), 10)).text == "short"


def test_file_safe_names(spark):
    long_url = "https://x/" + "é" * 200
    assert value(spark, identity.safe_name(F.lit("https://a/b?c"))) == "https___a_b_c"
    name = value(spark, identity.safe_name(F.lit(long_url)))
    assert len(name) == 80 + 1 + 12 + 1 + 40 and hashlib.sha256(long_url.encode()).hexdigest()[:12] in name


def test_fields_cannot_shift(spark):
    a = value(spark, identity.provenance_fingerprint(F.lit("alpha\x1fbeta"), F.lit("")))
    assert a != value(spark, identity.provenance_fingerprint(F.lit("alpha"), F.lit("beta")))


def test_citation_types_and_licenses(spark):
    cases = {"https://x/a.PDF": "pdf-document", "https://docs.oracle.com/x": "api-documentation", "https://github.com/x": "code-repository", "https://x.org": "external-link", "/x": "local-link", "x": "unknown", "": "unknown"}
    assert {u: value(spark, urls.citation_type(F.lit(u))) for u in cases} == cases
    assert value(spark, urls.license_of(F.lit("GNU LESSER GPL version 3"))) == "GPL-3.0"
    lines = {"permit me": "", "mit": "", "ISC License": "ISC", "GNU AGPL": "AGPL-3.0", "LGPL": "LGPL-3.0", "The Unlicense": "Unlicense", "MPL 2": "MPL-2.0", "Mozilla": "", "GNU AGPL 3": "GPL-3.0"}
    assert {x: value(spark, urls.license_of(F.lit(x))) for x in lines} == lines
    assert value(spark, urls.language_of_file(F.lit("x.gradle.kts"))) == "kotlin"


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("Compare Java 24 with JDK 21 and Java SE 24", ["24", "21"]),
        ("Java 21/24/25 streams", ["21", "24", "25"]),
        ("Java 21 with 50 examples", ["21"]),
        ("Compare Java 21 and 24 and 2 examples", ["21", "24"]),
        ("Compare 21 and 24 examples", []),
        (None, []),
    ],
)
def test_requested_versions(query, found):
    assert query_parse.requested_versions(query, ["21", "24", "25"]) == found


def test_boosted_question():
    assert query_parse.boosted("q", ["21", "24"]) == "JDK 21 Java SE 21 Java 21 release documentation; JDK 24 Java SE 24 Java 24 release documentation: q"


@pytest.mark.parametrize(
    ("said", "found"),
    [("( E , java . lang . String [ ] , T ... )", "(E,java.lang.String[],T...)"), ("(int[]...)", "(int[]...)"), ("()", "()"), ("(firstValue, x)", None), ("(List<E>)", None), ("(String, String)", None), ("(Map.Entry)", None), ("(E,", None)],
)
def test_invocation_signatures(said, found):
    assert query_parse.invocation_signature(said) == found


def test_chained_calls_name_no_member():
    assert query_parse.unique_member("a.of().stream()") is None and query_parse.unique_member("List.of(x).stream()") is None


def test_constraints():
    c = Constraint(doc_versions=[" 21", "24", "21", ""], doc_sets=["a", "b"])
    assert c.doc_versions == ["21", "24"] and c.with_doc_versions(["24", "21", "9"]).doc_versions == ["24", "21"]
    with pytest.raises(ValueError):
        c.with_doc_versions(["9"])
    assert c.collections({"a", "b", "c"}, ["github-x"]) == ["docs", "pdfs"] and "github-x" in c.collections({"a"}, ["github-x"])
    api = {"21": "java21", "25": "java25"}
    assert Constraint(doc_sets=["java21", "java25", "x"]).newest_api_only([], api).doc_sets == ["java25", "x"]
    assert Constraint(doc_sets=["java21", "java25"]).newest_api_only(["21"], api).doc_sets == ["java21", "java25"]
    assert Constraint(doc_sets=["java25"]).applicable_versions(["21", "25"], api) == ["25"]
    with pytest.raises(LookupError):
        require_evidence([], "member")


def test_strict_answers():
    assert strict_json.rerank_order('{"order": [2, 0]}', 4) == [2, 0] and strict_json.rerank_order('{"order": []}', 4) == []
    for bad in ('{"order":[1,1,0,2]}', '{"order":[null]}', '{"order":[-1]}', '{"order":[4]}', '{"order":[0],"x":1}', 'so {"order":[0]}', '```{"order":[0]}```', '{"order":[0]} x', '{"order":[0]}{"order":[0]}', '{"order":[0],"order":[1]}', '{"order":[0.0]}', '{"order":["0"]}', '{"order":[true]}'):
        with pytest.raises(ValueError):
            strict_json.rerank_order(bad, 4)
    assert strict_json.enrichment('{"hints": [" a ", ""], "packageName": " p "}')["hints"] == ["a"]


PAGE = """<html><head><title>T</title></head><body><nav>menu</nav><main><h1>Head</h1><p>Some   text &amp; more.</p><pre>  code
\tx</pre><ul><li>one<ul><li>two</li></ul></li><li>three</ul><table><tr><th>a<th>b<tr><td>1</td><td>2</td></table><div class="sidebar">side</div><p>ab</p></main><footer>f</footer>
<a href="/x#f">l</a><a href="y.html">m</a><a href="/x">n</a><a href="mailto:z">o</a></body></html>"""


def test_clean_text_and_links():
    got = html.clean_text(PAGE)
    assert "menu" not in got and "side" not in got and "Head\n" in got and "Some text & more." in got
    assert "```\n  code\n\tx\n```" in got and all(x in got for x in ("• one", "  • two", "• three", "a | b", "1 | 2"))
    assert "\nab" not in got
    assert html.links(PAGE, "https://h.org/d/p.html") == ["https://h.org/x", "https://h.org/d/y.html"]
    assert html.clean_text(None) == "" and html.links("", "https://x") == []


def test_page_guard():
    assert html.rejection("<title>404 Not Found</title><body><h1>404 not found</h1>nginx</body>") == "error page structure"
    assert html.rejection("<title>Just a moment...</title><script src='/cdn-cgi/challenge-platform/x'></script><div id='challenge-stage'>wait</div>") == "challenge structure"
    assert html.rejection("<title>Just a moment...</title><script src='/cdn-cgi/challenge-platform/x'></script><div>wait here</div>") is None
    assert html.rejection("<div id='cf-error-details'><b class='cf-error-code'>x</b></div>") == "CDN error structure" and html.rejection("<div id='cf-error-details'>much text</div>") is None
    assert html.rejection("<title>500 Internal Server Error</title><body><h1>500 Internal Server Error</h1></body>") is None
    page = "<head>{}<title>Page not found</title></head><body><main><h1>Page not found</h1>text</main></body>"
    assert html.rejection(page.format("")) is None and html.rejection(page.format("<meta name=robots content='NOINDEX, x'>")) == "error page structure"
    assert html.rejection("<title>Access denied</title><body><center><h1>Access Denied</h1></center></body>") == "error page structure"
    assert html.rejection("<title>Access denied</title><body><div><h1>Access Denied</h1></div></body>") is None
    assert html.rejection("<body></body>") == "empty body text" and html.rejection(PAGE) is None


def test_page_sections():
    page = "<main><h1>List</h1><p>Overview of the type.</p><section class='detail' id='of(E)'><h3>of</h3><p>Makes a list.</p></section></main>"
    assert html.page_sections(page) == [("", "List\n\nOverview of the type."), ("of(E)", "of\n\nMakes a list.")] or [a for a, _ in html.page_sections(page)] == ["", "of(E)"]


@given(st.lists(st.sampled_from(["# a\n", "text\n", "```\n", "## b\n", "\n", "#c\n"]), max_size=12))
@settings(max_examples=100, deadline=None)
def test_sections_lose_nothing(parts):
    assert "".join(markdown.sections("".join(parts))) == "".join(parts)


def test_hints():
    md = "{{hint: a}} `{{hint:code}}` {{warning:b}}}\n```\n{{hint:x}}\n```\n{{example: }}{{hint:open"
    assert [(k, t) for k, t, _ in markdown.hints(md)] == [("hint", "a"), ("warning", "b}")]
    assert markdown.without_reference_marks("a [1] b [2](u)") == "a b [2](u)"


def test_sitemaps_and_mirror_paths(spark):
    xml = "<urlset xmlns='http://x'><url><loc> https://a.org/1 </loc></url><url><loc>https://a.org/2</loc></url></urlset>"
    assert files.sitemap_locations(xml) == ["https://a.org/1", "https://a.org/2"]
    with pytest.raises(ValueError):
        files.sitemap_locations("<!DOCTYPE x><a/>")
    cases = {"https://a.org/": "index.html", "https://a.org/x/y": "x/y.html", "https://a.org/d/": "d/index.html", "https://a.org/download.asp": "download.asp.html", "http://a.org/x": None, "https://u@a.org/x": None, "https://a.org/../x": None, "https://a.org/x?y": None}
    assert {u: value(spark, files.mirror_path(F.lit(u))) for u in cases} == cases


@given(st.lists(st.integers(0, 12), max_size=12), st.integers(0, 30))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_greedy_fit_skips_misfits(spark, tokens, budget):
    from docloom.operators.prompt import greedy_fit

    items = F.lit(None).cast("array<struct<i:int,tokens:int>>") if not tokens else F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("tokens")) for i, t in enumerate(tokens)))
    got = value(spark, greedy_fit(items, F.lit(budget)))
    kept, left = [], budget
    for i, t in enumerate(tokens):
        if t <= left:
            kept.append(i)
            left -= t
    assert [x.i for x in got or []] == kept


def test_word_breaks(spark):
    cases = {
        "don't stop": ["don't", "stop"], "3.14 and 1,000;5": ["3.14", "and", "1,000;5"], "a_b _c_ __ d__e": ["a_b", "_c_", "d__e"], "can’t o:k l·l": ["can’t", "o:k", "l·l"], "a,b x;y": ["a", "b", "x", "y"], "end. 'q' ..x..": ["end", "q", "x"],
        "a1b2 1a 3.a a.3": ["a1b2", "1a", "3", "a", "a", "3"], "漢字かな": ["漢", "字", "か", "な"], "カタカナ語": ["カタカナ", "語"], "カa": ["カ", "a"], "été a‍b": ["été", "a‍b"], "한국어 말": ["한국어", "말"], "สวัสดี": ["สวัสดี"], "": [], None: [], "a.b.c": ["a.b.c"], "a..b": ["a", "b"], "1.,2": ["1", "2"],
        "x" * 1500 + "!": ["x" * 1500], "I.B.M.": ["I.B.M"], "שלום": ["שלום"], "a­b": ["a­b"], "a​b": ["a", "b"], "٣٫٤": ["٣٫٤"], "ﬁne Ⅷ": ["ﬁne", "Ⅷ"], "- – — ?!": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", text.words(F.col("x")).alias("w"), sparse.standard_terms(F.col("x")).alias("t")).orderBy("i").collect()
    assert {x: r.w for x, r in zip(cases, rows)} == cases
    assert [r.t for r in rows][:3] == [["don't", "stop"], ["3.14", "and", "1,000;5"], ["a_b", "_c_", "d__e"]]
    long = spark.createDataFrame([("ab1_" * 200_000,), ("don't " * 100_000,)], "x string").select(F.size(text.words(F.col("x")))).collect()
    assert [r[0] for r in long] == [1, 100_000]


def test_a_keyword_score_lowers_its_text_once(spark):
    from docloom.queries.retrieval_queries import i12_keyword_search

    plan = i12_keyword_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    rows = spark.createDataFrame([(1, "thE thing"), (2, None), (3, "")], "id int, t string")
    found = rows.select(text.keyword_score(text.ascii_lower(F.col("t")), F.array(F.lit("th"), F.lit("the"), F.lit("")))).collect()
    assert [r[0] for r in found] == [3 / 50, 0.0, 0.0]
