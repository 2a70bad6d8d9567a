"""Fill-in-the-middle, line deduplication and the manifest, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from docloom.llm import fill_middle, line_dedup, manifest

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "one", " two words ", "héllo wörld 😀  x\n\n\ny", "a <P> b", "<S>", "x<M>y z", "<P <S <M > P> S> M>", "\x00\x0b\x0c\r\n", "w " * 3000, "z" * 40_000, " " * 9000 + "q" + "\t" * 9000, "日本語 テキスト　です"]


def clashing(spark, rows, names):
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


def plain_fim(doc_id, text, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, p, m, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(7, "again and again"), (7, "again and again"), (None, "no id here at all"), (-5, "minus five words of text")]
    docs = clashing(spark, rows, ["n", "form", "prefix", "at", "output", "plain"])
    found = fill_middle.fill_in_middle(docs, stretch=50).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    expected = sorted((str(i), plain_fim(i, t), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), (r.n, r.form, r.prefix, r.middle, r.output), r.back) for r in found) == expected
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_stretches_do_not_change_tokens():
    split = pre_tokenizers.Split(Regex(fill_middle.TOKEN), "isolated").pre_tokenize_str
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(" \t\nab é😀") for _ in range(rng.randrange(60)))
        ends = [m.end() for m in TOKEN.finditer(text)]
        assert all(list(fill_middle.token_ends(split, text, k)) == ends for k in (1, 2, 7, 1000))


def test_marks_that_cannot_be_found_again(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aba", "x", "y"), ("ab", "bc", "d"), ("a", "xay", "z")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, marks=marks)
    every = fill_middle.fill_in_middle(docs, rate=100, marks=("[p]", "[s]", "[m]")).first()
    assert every.form != "plain" and "[m]" in every.output


def plain_lines(rows, chars=20, least=3):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[low(line.strip(" \t\n\x0b\x0c\r"))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = []
        for line in lines:
            key = low(line.strip(" \t\n\x0b\x0c\r"))
            over = len(key) >= chars and len(holders[key]) >= least
            gone.append(over and i != max((x for x in holders[key] if x is not None), default=None))
        out.append((str(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


SHARED = "This line is shared by MANY documents"


def test_lines_against_python(spark):
    rows = [(i, f"own line number {i} of some length\n  {SHARED.lower() if i % 2 else SHARED}\t\nshort\nshort\n{SHARED}\n") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, SHARED), (53, SHARED), (53, "other text of the same id\n" + SHARED), (None, SHARED + "\nx"), (None, "y\n" + SHARED), (54, "É" * 20), (55, "é" * 20), (56, "É" * 20)]
    rows += [(60, "twice only, in two documents"), (61, "twice only, in two documents"), (62, "exactly twenty chars"), (63, "exactly twenty chars"), (64, "exactly twenty chars"), (65, "only nineteen chars"), (66, "only nineteen chars"), (67, "only nineteen chars")]
    rows += [(68, f"{SHARED}\r\n" * 30_000 + "end"), (69, " exactly twenty chars"), (70, "one document, many times\n" * 9), (None, "exactly twenty chars"), (71, "L" * 300_000), (72, "l" * 300_000), (73, "L" * 300_000 + " ")]
    docs = clashing(spark, rows, ["key", "pos", "lost", "row", "keep_id", "h1", "bits0", "at", "lines"])
    found = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).collect())
    assert found == plain_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    none = line_dedup.dedup_lines(docs, least_docs=1000).collect()
    assert len(none) == len(rows) and not any(r.n_dropped for r in none)


def plain_manifest(rows):
    """Leaves, roots, proofs and folded roots by recursion over lists; rows are (doc_id, source, lang, n_chars, text)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(leaves):
        """The top and each leaf's path, [(before, behind)]."""
        nodes, paths, under = leaves, [[] for _ in leaves], [[i] for i in range(len(leaves))]
        while len(nodes) > 1:
            up, below = [], []
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for j in range(len(run)):
                    for i in under[a + j]:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(sha("".join(run)))
                below.append([i for u in under[a : a + 16] for i in u])
            nodes, under = up, below
        return nodes[0], paths

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, above):
        top, paths = trees[s]
        for r, path in zip(by_source[s], paths):
            whole = path + upper
            changed = re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4]
            node = leaf((*r[:4], changed))
            for a, b in whole:
                node = sha(a + node + b)
            out.append((str(r[0]), leaf(r), top, root, sha("".join(a + b for a, b in whole)), node, node == root))
    return sorted(out)


def found_manifest(docs, **more):
    low = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    proofs = manifest.prove_rows(docs, found={"text": low}, where=docs["doc_id"] % 3 == 0, **more)
    text = lambda x: bytes(x).hex()
    return sorted((str(r.doc_id), text(r.leaf), text(r.subroot), text(r.root), text(r.proof), text(r.folded), r.folded == r.root) for r in proofs.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place string, width string, at string, task string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("task_rows", [7, 50_000])
def test_manifest_against_lists(spark, task_rows):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)] + [(i, "hot", None, None, None) for i in (5, 5, 6)] + [(None, "hot", "de", 1, ""), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(i, f"s{i}", "en", 3, "lone Leaf") for i in range(400, 440)] + [(i, "sixteen", "fr", i, "É A") for i in range(500, 516)] + [(i, "seventeen", "fr", i, "x" * 1000) for i in range(600, 617)] + [(700, "", "", 0, "Empty"), (701, "é", "", 0, "long " * 50_000)]
    random.Random(1).shuffle(rows)
    assert found_manifest(table(spark, rows), task_rows=task_rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert found_manifest(table(spark, rows)) == plain_manifest(rows)


def test_manifest_of_no_rows_and_changed_rows(spark):
    docs = table(spark, [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(60)])
    assert manifest.prove_rows(docs.limit(0)).collect() == []
    proofs = manifest.prove_rows(docs, with_paths=True)
    root = bytes(proofs.first().root)
    assert all(r.folded == r.root for r in proofs.collect())
    later = docs.withColumn("text", F.when(F.col("doc_id") == 7, "changed").otherwise(F.col("text"))).where("doc_id <> 8").unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(900).cast("long")))
    found = {r.doc_id: r.verified for r in manifest.verify_rows(later, proofs, root).collect()}
    assert found == {**{i: i != 7 for i in range(60) if i != 8}, 900: False}
    # A forged path leads elsewhere.
    forged = proofs.withColumn("path", F.transform("path", lambda p: F.struct(p["behind"].alias("before"), p["before"].alias("behind"))))
    assert not any(r.verified for r in manifest.verify_rows(docs, forged, root).collect())
