"""Every registered query on the smallest tables, against DuckDB or plain Python."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import catalog, language_id, lm_score, pii, url_filter
from tests.llm.test_dedup import brute, lower, shingles
from tests.llm.test_filters import plain, verdict
from tests.test_queries import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(FOLDER):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    found = catalog.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, cursor.fetchall())


def test_lm_score_counts_and_base(spark, table):
    found = {r.doc_id: r for r in catalog.op1_lm_score(spark, FOLDER).collect()}
    docs = {r.doc_id: [*(w.decode() for w in lower(r.text).split()), "</s>"] for r in table("documents")}
    counts = Counter(w for i, words in docs.items() if fold(i) != 1 for w in words)
    n = sum(counts.values())
    assert set(found) == set(docs)
    for i, words in docs.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in words), rel=1e-9)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_near_dedup_of_all_documents(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents")]
    expected = brute(docs, 4)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in catalog.op2_near_dedup(spark, FOLDER).collect()}
    assert found == {i: (len(shingles(t, 4)), expected[i], expected[i] == i) for i, t in docs}


def test_pii_base_of_all_documents(spark, table):
    import hashlib

    found = {r.doc_id: r for r in catalog.op3_pii(spark, FOLDER).collect()}
    for d in table("documents"):
        spans, r = plain(d.text), found[d.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in pii.KINDS[:4]]
        every = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(every) and len(every) == r.n_spans


def test_url_verdicts_of_all_pages(spark, table):
    found = {r.page_id: r for r in catalog.op5_url_filter(spark, FOLDER).collect()}
    for p in table("pages"):
        host, path, rule, said = verdict(p.url)
        r = found[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (said or ("block" if r.mined else "allow"))


def test_languages_of_held_out_documents(spark, table):
    found = {r.doc_id: r for r in catalog.op6_language_id(spark, FOLDER).collect()}
    docs = table("documents")
    assert all(found[d.doc_id].held_out == (fold(d.doc_id) == 0) and 0 <= found[d.doc_id].score <= 1 for d in docs)
    held = [d for d in docs if found[d.doc_id].held_out and any(c.isalpha() for c in d.text or "")]
    assert sum(found[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held) > 20


def test_profiles_by_plain_loops(table):
    """Binding, permuting and bundling, letter by letter."""
    p = language_id.Profiles(64)
    texts = [r.text[:3000] if r.text else r.text for r in table("documents")[:12]] + ["", None, "ß", "日本", "a1b2", "x" * 9]
    for text, found in zip(texts, p.bundles(texts)):
        letters, last = [language_id.GAP], True
        for c in (text or "").lower():
            if c.isalpha():
                letters.append(ord(c))
            elif letters[-1] != language_id.GAP:
                letters.append(language_id.GAP)
        if letters[-1] != language_id.GAP:
            letters.append(language_id.GAP)
        if len(letters) == 1:
            assert found is None
            continue
        total = np.zeros(64)
        for i in range(len(letters) - 2):
            bound = np.ones(64)
            for j in range(3):
                bound = bound * np.roll(p.letter(letters[i + j]), j + 1)
            total += bound
        assert np.array_equal(total, found), text


def test_token_counts_of_all_documents(spark, table):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op7_token_count(spark, FOLDER).collect()}
    docs = table("documents")
    assert max(len(d.text or "") for d in docs) > catalog.token_count.WHOLE
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert found[d.doc_id] == (len((d.text or "").encode()), n, n > 512)


def test_language_stage_rejects_chance_and_fills(spark, table):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    prototypes, least = language_id.learn_prototypes(docs), language_id.by_chance()
    more = spark.createDataFrame([(9001, "日本語 テキスト 漢字", None), (9002, docs.first().text, None), (9003, "12 34", "en")], "doc_id long, text string, lang string")
    left = {r.doc_id: r.lang for r in language_id.drop_unidentified(more, prototypes, least=least).collect()}
    assert left == {9002: docs.first().lang}
    judged = {r.doc_id: r.score for r in language_id.identify_languages(docs, prototypes).collect()}
    kept = {r.doc_id for r in language_id.drop_unidentified(docs, prototypes, least=least).collect()}
    assert kept == {i for i, s in judged.items() if s >= least}
    other = {k: np.roll(v, 7) for k, v in prototypes.items()}  # of no use: the stage's result follows the prototypes
    assert language_id.drop_unidentified(docs, other, least=least).count() < len(kept) / 2


def test_too_many_languages_are_an_error(spark):
    rows = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError):
        language_id.learn_prototypes(rows, most=4)


HARD = [(1, None), (2, ""), (3, " \t"), (4, "word " * 60_000), (5, "x" * 300_000), (6, "same text of five words"), (6, "same text of five words"), (None, "no id"), (7, "same text of five words")]


def test_all_text_operators_on_hard_rows(spark):
    """Nulls, blanks, very long texts, repeated rows, and columns named as the outputs are."""
    names = "score, n_tokens, lang_pred, n_hit, kept, spans, taken, copies, dropped_id, __sha, key"
    docs = spark.createDataFrame([(i, t, "en", "s", *["clash"] * 11) for i, t in HARD], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names.split(", ")))
    model = lm_score.train(docs)
    path = public_tokenizers.path("byte_bpe_50k.json")
    items = spark.createDataFrame([(1, "same text of five words")], "item_id long, text string")
    results = {
        "lm": lm_score.score(docs, model), "near": catalog.near_dedup.near_dedup(docs), "pii": pii.find_pii(docs, pii.Judge(spark, 600)), "exact": catalog.exact_dedup.exact_dedup(docs),
        "lang": language_id.identify_languages(docs, language_id.learn_prototypes(docs)), "tokens": catalog.token_count.count_tokens(docs, path), "mix": catalog.mixing.mix_sources(docs), "hits": catalog.decontaminate.find_contamination(docs, items),
    }
    found = {k: x.collect() for k, x in results.items()}
    assert {k: len(x) for k, x in found.items()} == {k: len(HARD) for k in results}
    assert sorted(r.n_tokens for r in found["lm"])[-1] == 60_001
    assert sorted(r.n_words for r in found["hits"])[-1] == 60_000 and sum(r.contaminated for r in found["hits"]) == 3
    for stage in (lambda d: catalog.near_dedup.drop_near_copies(d), lambda d: catalog.exact_dedup.drop_copies(d), lambda d: catalog.decontaminate.drop_contaminated(d, items), lambda d: language_id.drop_unidentified(d, language_id.learn_prototypes(d), least=0.01)):
        assert stage(docs).columns == docs.columns and stage(docs).count() > 0
    assert catalog.mixing.draw_mix(docs).count() > 0


def test_more_shards_than_ranges(spark, monkeypatch):
    texts = [f"w{i % 17} w{i % 5} w{i % 11} w{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain_scores = {r.doc_id: r.score for r in lm_score.score(docs, lm_score.train(docs, shard_rows=40)).collect()}
    monkeypatch.setattr(lm_score, "RANGES", 3)
    model = lm_score.train(docs, shard_rows=40)
    assert model.shards > 9
    assert {r.doc_id: pytest.approx(r.score) for r in lm_score.score(docs, model).collect()} == plain_scores


def test_ties_of_rules_and_bounds(spark):
    pages = spark.createDataFrame([(1, "http://a-b.net/x")], "page_id long, url string")
    rules = spark.createDataFrame([("w:a", ["w:a"], "w:a", 0.9, 0.1), ("w:b", ["w:b"], "w:b", 0.9, 0.1)], "rule string, tokens array<string>, pivot string, confidence double, support double")
    assert url_filter.filter_urls(pages, rules).first().mined == "w:b"
    few = spark.range(1).select(url_filter.lower_bound(F.lit(5), F.lit(5), 1.645).alias("a"), url_filter.lower_bound(F.lit(500), F.lit(500), 1.645).alias("b")).first()
    assert 0.6 < few.a < 0.7 and few.b > 0.99
    rows = spark.createDataFrame([(["a"], True)] * 4 + [(["z"], False)] * 40, "tokens array<string>, block boolean")
    assert url_filter.mine_rules(rows, support=0.01).count() == 0
