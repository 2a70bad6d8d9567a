import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, exact_dedup, near_dedup
from docloom.llm.words import mixed

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], SCHEMA)


EXACT = [(1, "Same"), (2, "sAME"), (7, "same"), (3, ""), (4, None), (5, "É"), (6, "é"), (8, "x" * 5000), (9, "x" * 4999 + "X"), (10, "x" * 4999 + "y"), (11, "x" * 5001), (11, "x" * 5001), (None, "same"), (None, "alone"), (12, "y" * 96 + "x" * 100)]


def lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("block", [32, 32768])
def test_exact_dedup_against_a_dictionary(spark, weak, block):
    route = (lambda c: (F.length(c) % 2).cast("long")) if weak else F.xxhash64
    found = exact_dedup.exact_dedup(docs(spark, EXACT), block_bytes=block, route=route).collect()
    groups = defaultdict(list)
    for i, t in EXACT:
        groups[lower(t)].append(i)
    assert len(found) == len(EXACT)
    expected = Counter((i, hashlib.sha256(lower(t)).hexdigest(), max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)])) for i, t in EXACT)
    assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    left = exact_dedup.drop_copies(docs(spark, EXACT))
    assert left.columns == ["doc_id", "text", "lang", "source", "kept"]
    rows = left.collect()
    assert len(rows) == len({lower(t) for _, t in EXACT}) == len({lower(r.text) for r in rows})


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == near_dedup.drop_near_copies(none).count() == 0


def shingles(text, k):
    w = lower(text).split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def made_up(seed, families=6, size=40, words=120):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows, doc = [], 100
    passage = [f"p{x}" for x in range(60)]
    for f in range(families):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(size):
            text = list(base)
            for _ in range(int(rng.integers(0, 7))):
                text[int(rng.integers(0, words))] = f"z{rng.integers(0, 10**6)}"
            rows.append((doc, " ".join(text + (passage if rng.random() < 0.3 else []))))
            doc += 1
    for _ in range(60):  # a shared passage alone makes no link
        rows.append((doc, " ".join(passage + [f"q{x}" for x in rng.integers(0, 10**6, 60)])))
        doc += 1
    return rows + [(1, "a b"), (2, "A  b"), (3, ""), (4, None), (5, " \t"), (6, "a b c d"), (7, "a b c d")]


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_against_all_pairs(spark, k):
    rows = made_up(k)
    found = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, rows), words=k).collect()}
    expected = brute(rows, k)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(found[i].n_shingles == len(shingles(t, k)) and found[i].kept == (expected[i] == i) for i, t in rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = made_up(9, families=3, size=25)
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs(spark, rows), words=4).collect()}
    assert found == brute(rows, 4)


def test_near_dedup_without_and_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, "quite another text of some words"), (9, "quite another text of some words"), (None, "no id here and no copy")]
    found = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_drop_near_copies_judges_rows_of_null_and_repeated_ids(spark):
    text, other, third = (" ".join(f"{p}{i}" for i in range(50)) for p in "wvu")
    rows = [(None, text), (5, text), (5, "quite another text of some words"), (9, "quite another text of some words"), (None, "no id here and no copy")]
    rows += [(3, text + " more"), (None, other), (None, other + " more"), (None, third), (None, third), (None, ""), (12, None)]
    left = near_dedup.drop_near_copies(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "kept"]
    found = [(r.doc_id, r.text) for r in left.collect()]
    others = [x for x in found if (x[1] or "").startswith(other)]
    assert len(others) == 1 and others[0][0] is None
    assert Counter(x for x in found if x not in others) == Counter([(3, text + " more"), (5, rows[2][1]), rows[4], (None, third), (None, ""), (12, None)])


def test_near_copies_without_ids_are_linked(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(base + ["more"])), (None, " ".join(base)), (7, " ".join(f"x{i}" for i in range(60))), (None, " ".join(f"x{i}" for i in range(61)))]
    found = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == Counter([(None, None, True), (None, None, False), (None, None, False), (7, 7, True), (None, 7, False)])


def test_the_first_common_band_is_one_of_equal_values(spark):
    # All cuts of the signatures agree, the values only in band 5.
    sig, bands = bytes(2 * near_dedup.PLACES), lambda n: [77 if b == 5 else 1000 * n + b for b in range(near_dedup.BANDS)]
    reps = spark.createDataFrame([(n, 1, n, 50, bands(n), bytearray(sig)) for n in (1, 2, 3)], "rep long, a long, b long, n long, bands array<long>, sig binary")
    shared = spark.createDataFrame([(77, 5, n, 3, 30) for n in (1, 2, 3)], "key long, band int, rep long, centre long, members long")
    labels, tried = spark.createDataFrame([], "id long, comp long"), spark.createDataFrame([], "a long, b long, linked boolean, missing array<long>, added array<long>")
    found = near_dedup._across(shared, labels, reps, tried, 0.8).collect()
    assert {(1, 2)} <= {(r.a, r.b) for r in found}


def test_superminhash_estimates_jaccard():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (3, 50, 2000):
        x = mixed(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        errors = []
        for i in range(30):
            a, b = mixed(x[: 2 * n] + np.uint64(i)), mixed(x[n:] + np.uint64(i))
            errors.append((near_dedup.superminhash(a) == near_dedup.superminhash(b)).mean() - 1 / 3)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
