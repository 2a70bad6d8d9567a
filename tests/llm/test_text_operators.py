import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import chat_format, decontaminate, language_id, lm_score, mixing, token_count

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, h string")


# Decontamination

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "tiny item"), (3, None), (4, ""), (5, "ONE two three four five six seven eight nine ten"), (None, "nobody's")]
TEXTS = [
    (1, "well one TWO three, four five six seven eight nine ten. eleven tiny"),
    (2, "a tiny, item and tiny item again"),
    (3, None),
    (4, ""),
    (5, "one two three four five six seven eight nine and ten"),
    (6, "é one two three four five six seven eight nine ten eleven é"),
    (6, "nobody s"),
    (7, "tiny"),
    (8, "item"),
]


def contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i) if i is not None else "")
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for a in range(len(w)):
            for k in range(1, 11):
                if a + k <= len(w) and tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("most", [1000, 2])
def test_contamination_against_all_windows(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(docs(spark, TEXTS), items, most_windows=most)
    assert Counter(map(tuple, found.collect())) == contamination(TEXTS, ITEMS)


def test_drop_contaminated(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.drop_contaminated(docs(spark, TEXTS), items)
    assert left.columns == ["doc_id", "text", "h"]
    assert Counter(r.doc_id for r in left.collect()) == Counter(k[0] for k in contamination(TEXTS, ITEMS).elements() if not k[5])
    assert decontaminate.drop_contaminated(docs(spark, TEXTS), items.limit(0)).count() == len(TEXTS)
    assert decontaminate.find_contamination(docs(spark, []), items).count() == 0


def test_drop_contaminated_judges_rows_alike_in_slices(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14))), (2, "short item")], "item_id long, text string")
    hit = "so " + " ".join(f"w{i}" for i in range(3, 13)) + " said"
    rows = [(None, hit), (None, "clean words"), (4, hit), (4, "other clean words"), (5, "a short item here"), (6, None)]
    for most in (1, 2, 1000):
        left = decontaminate.drop_contaminated(docs(spark, rows), items, most)
        assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([rows[1], rows[3], rows[5]])


# Chat formatting

def test_chats_can_be_read_back(spark):
    hard = ["<|turn|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<", "\\<|", "[\\\\INST]", "a\n<|says|>b<|end|>", "", None, "<|", "|>", "é\\"]
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], hard[(c * 5 + t) % len(hard)]) for c in range(12) for t in range(c)]
    rows += [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, None, "user", "x"), (50, 1, "assistant", "a"), (None, 0, None, "<|r"), (60, 0, "<|x|>", "y")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, said string")
    examples = chat_format.format_chats(table)
    back = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    chats = defaultdict(list)
    for c, t, role, text in rows:
        chats[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        assert [(x.role, x.text) for x in back[c].turns] == [(r, t) for _, r, t in turns]
        assert back[c].loss == "".join(t for _, r, t in turns if r == "assistant")
    made = examples.collect()
    assert sum(x.target is not None for x in made) == sum(r == "assistant" for turns in chats.values() for _, r, _ in turns)
    assert chat_format.format_chats(table.limit(0)).count() == 0


# Token counts

SPECIAL = "x <|endoftext|> y"
HARD = [SPECIAL * 700, "a" * 9000 + " b", "é'" * 3000 + "  \n\n  t" * 500, "we're it's 12345 " * 400, " " * 5000 + "x", "<|endo" * 900 + "ftext|>", "", None, "日本語テキスト" * 500]


def test_token_counts_with_and_without_chunks(spark):
    table = docs(spark, [*enumerate(HARD), (0, HARD[0])])
    reference = Tokenizer.from_file(TOKENIZER)
    expected = Counter((i, len((t or "").encode()), n := len(reference.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in [*enumerate(HARD), (0, HARD[0])])
    for sizes in ({}, {"whole": 300, "chunk": 200, "overlap": 80}, {"whole": 1000, "chunk": 777, "overlap": 70}):
        assert Counter(map(tuple, token_count.count_tokens(table, TOKENIZER, **sizes).collect())) == expected
    assert token_count.count_tokens(table.limit(0), TOKENIZER).count() == 0


# Language identification

def test_token_counts_by_piece():
    """Pieces at every kind of boundary, special strings and unusual characters, against the library."""
    tokenizer = token_count._tokenizer(TOKENIZER)
    of, parts = token_count._counter(tokenizer), ["it's", "''s", "IT'S", "  ", "\n", "\n\n ", "\t", " a", "9x9", "!?", "é", "ſ", "×÷", "\u00a0", "\x1c", "漢字", "<|endoftext|>", "q" * 50, "'ll've", "日 "]
    for a in parts:
        for b in parts:
            text = f"{a}{b} {a}\n{b}{b}"
            assert of(text) == of(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("that is the thing", "en"), ("der hund und die katze", "de"), ("das ist der ding", "de"), (None, "de"), ("kein", None)] * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_id.learn_prototypes(table)
    assert list(prototypes) == ["de", "en"]
    tests = docs(spark, [(1, "the other thing"), (2, "und der"), (3, None), (4, ""), (5, "12 34 ."), (6, "THE CAT"), (6, "x"), (7, "日本語")])
    found = language_id.identify_languages(tests, prototypes).collect()
    assert [(r.doc_id, r.lang_pred) for r in found][:6] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    assert all(0 <= r.score <= 1 for r in found) and len(found) == 8
    assert language_id.identify_languages(tests, {}).where("lang_pred = 'und' AND score = 0").count() == 8
    assert {r.doc_id for r in language_id.drop_unidentified(tests, prototypes).collect()} == {1, 2, 6, 7}
    assert language_id.learn_prototypes(table.limit(0)) == {}


def test_profiles_do_not_depend_on_kept_vectors(monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog", "zebra", None]
    whole = list(language_id.Profiles().bundles(texts))
    monkeypatch.setattr(language_id, "MOST_KEPT", 5)
    parts = list(language_id.Profiles().bundles(texts))
    assert all((a is None and b is None) or np.array_equal(a, b) for a, b in zip(whole, parts))


# Language model

def kneser_ney(train, order):
    """Probabilities by the textbook, with dictionaries."""
    words = lambda t: ["<s>"] * (order - 1) + (t or "").lower().split() + ["</s>"]
    counts = {order: Counter(tuple(w[i - order + 1 : i + 1]) for w in map(words, train) for i in range(order - 1, len(w)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: [0.0, *lm_score.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])] for k, c in counts.items()}
    followers = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            followers[k][g[:-1]].append(v)
    vocabulary = len(counts[1])

    def p(k, context, word):
        lower = 1 / (vocabulary + 1) if k == 1 else p(k - 1, context[1:], word)
        seen = followers[k].get(context)
        if not seen:
            return lower
        c = counts[k].get((*context, word), 0)
        return (c - d[k][min(c, 3)] + sum(d[k][min(v, 3)] for v in seen) * lower) / sum(seen)

    def score(text):
        w = words(text)
        return sum(math.log10(p(order, tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_the_textbook(spark, order):
    rng = np.random.Generator(np.random.PCG64(order))
    train = [" ".join(f"w{x}" for x in rng.zipf(1.6, rng.integers(1, 40)) % 50) for _ in range(120)] + ["", None]
    tests = ["w1 w2 w3", "W1  w1\tw1 unknown w2", "", None, *train[:5]]
    model = lm_score.train(docs(spark, enumerate(train)), order=order, shard_rows=60)
    found = {r.doc_id: r for r in lm_score.score(docs(spark, enumerate(tests)), model).collect()}
    textbook = kneser_ney(train, order)
    plain = Counter(w for t in train for w in [*(t or "").lower().split(), "</s>"])
    assert model.shards > 3 and model.tokens == sum(plain.values()) and model.words == len(plain)
    for i, t in enumerate(tests):
        words = [*(t or "").lower().split(), "</s>"]
        assert found[i].n_tokens == len(words) and found[i].n_known == sum(w in plain for w in words)
        assert found[i].score == pytest.approx(textbook(t), abs=1e-9)
        assert found[i].base_score == pytest.approx(sum(math.log10((plain[w] + 0.5) / (model.tokens + 0.5 * (model.words + 1))) for w in words), abs=1e-9)


def test_language_model_of_nothing(spark):
    model = lm_score.train(docs(spark, []))
    rows = lm_score.score(docs(spark, [(1, "a b"), (2, None)]), model).collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in rows] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm_score.score(docs(spark, []), model).count() == 0


# Mixing

def targets(sizes, weights=(5, 2, 1), most=3):
    """By sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), s) for i, s in enumerate(["b"] * 400 + ["a"] * 30 + [None] * 50 + ["c"] * 5 + ["é"] * 100)] + [(7, None, "b"), (None, "a b", "c"), (None, "a c", "c")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, h int")
    found = mixing.mix_sources(table).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected, taken = targets(sizes), defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 60 for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(table.repartition(7)).collect()))
    drawn = mixing.draw_mix(table)
    assert drawn.columns == ["doc_id", "text", "source", "h", "copies", "taken"]
    assert sum(r.taken for r in drawn.collect()) == sum(taken.values())
    assert mixing.mix_sources(table.limit(0)).count() == 0
