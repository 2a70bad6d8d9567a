import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import language_id
from tests.llm.test_dedup import brute, lower
from tests.llm.test_text_operators import contamination, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of 200 rows, with cases added, and the benchmark."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.where("doc_id = 3").first().text
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    more = [(9001, text.upper(), None, None, 1), (9002, text + " more", "fr", "src1", 1), (9003, "12 34 -", "en", "src0", 1), (9004, None, "en", "src0", 1), (9005, "clean words before. " + item + " after", "en", "src2", 1), (9006, "a b c", None, None, None), (9006, "A b c", "en", None, None), (None, "no id at all", None, None, None)]
    docs.unionByName(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def with_a_language(rows):
    """Rows nearer to a language than chance, by vectors that are bound, permuted and bundled gram by gram."""
    size, letters, grams = 2048, {}, {}
    profiles = language_id.Profiles(size)

    def letter(code):
        if code not in letters:
            letters[code] = profiles.letter(code)
        return letters[code]

    def vector(text):
        codes = [0]
        for c in (text or "").lower():
            if c.isalpha():
                codes.append(ord(c))
            elif codes[-1]:
                codes.append(0)
        codes += [0] if codes[-1] else []
        total = np.zeros(size)
        for gram, n in Counter(zip(codes, codes[1:], codes[2:])).items():
            if gram not in grams:
                grams[gram] = np.prod([np.roll(letter(x), j + 1) for j, x in enumerate(gram)], axis=0)
            total += n * grams[gram].astype(float)
        return total

    vectors = [vector(r.text) for r in rows]
    prototypes = {lang: sum(v for r, v in zip(rows, vectors) if r.lang == lang) for lang in {r.lang for r in rows} - {None}}
    unit = np.stack([x / np.linalg.norm(x) for x in prototypes.values()])
    return [r for r, v in zip(rows, vectors) if v.any() and (unit @ v).max() / np.linalg.norm(v) >= 3 / size**0.5]


def by_hand(rows, items):
    rows = with_a_language(rows)
    texts = {}
    for r in rows:
        key = lower(r.text)
        if key not in texts or (r.doc_id is not None and (texts[key].doc_id is None or r.doc_id > texts[key].doc_id)):
            texts[key] = r
    rows = list(texts.values())
    component = brute([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    hit = {k[0] for k in contamination([(r.doc_id, r.text) for r in rows], items) if k[5]}
    rows = [r for r in rows if r.doc_id not in hit]
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(lower(r.text).split())
    out = set()
    for source, target in targets(size).items():
        full = min(3, int(target // size[source])) if size[source] else 0
        rest, upto, more = target - full * size[source], 0, set()
        own = sorted((int(hashlib.md5(str(r.doc_id if r.doc_id is not None else r.text).encode()).hexdigest()[:15], 16), r.doc_id, len(lower(r.text).split())) for r in rows if r.source == source)
        for _, doc, n in own:
            if full < 3 and (upto + n <= rest or (upto <= rest and n < 2 * (rest - upto))):
                more.add(doc)
            upto += n
        out |= {(doc, full + (doc in more), n * (full + (doc in more))) for _, doc, n in own if full + (doc in more)}
    return out


def test_pipeline_against_brute_force(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.copies, r.taken) for r in found.collect()} == by_hand(rows, items)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
