"""Queries without SQL on tables made by hand, of texts that are longer than any prefix."""

import pytest

from docloom import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    late = "x" * 1200 + "\n# Late\n[b](https://y.org/b)\n{{warning: late}}\n"
    docs = [(1, "a" * 400), (2, "b" * 2000), (3, "c" * 4000), (4, "d" * 1200), (9, late)]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_markdown_is_read_to_its_end(spark, folder):
    found = {r.doc_id: r for r in queries.QUERIES["h46_h48_markdown"](spark, folder).collect()}
    assert (found[9].sections, found[9].links, found[9].hints) == (4, "https://x.org/a|https://y.org/b", "warning:late|hint:be careful")
    assert (found[1].sections, found[1].links, found[1].hints) == (3, "https://x.org/a", "hint:be careful")


def test_documents_that_do_not_fit_are_left_out_whole(spark, folder):
    # 750 tokens are left: 501 for document 2 but not 301 more for 4; then the turn, and 101 for document 1 but not 1001 for 3.
    (found,) = queries.QUERIES["i15_i16_fitted_prompt"](spark, folder).collect()
    assert (found.id, found.kept, found.turns, found.minimal, found.error) == (1, "1:LOW:101 2:HIGH:501", "0", False, False)


def test_deeply_nested_lists():
    from docloom.functions import html

    nested = "<p>Above the lists.</p>" + "<ul><li>item" * 3000 + "</li></ul>" * 3000
    lines = html.clean_text(f"<body>{nested}</body>").split("\n")
    assert lines[0] == "Above the lists." and lines[1] == "• item" and lines[-1] == "  " * 2999 + "• item" and len(lines) == 3001
    assert html.clean_text("<body><p>One.</p><ul><li>a b c d<ol><li>e f g h</li></ol><p>Said here.</p></li><li>i j k l</li></ul></body>").split("\n") == ["One.", "• a b c d", "  • e f g h", "Said here.", "• i j k l"]
