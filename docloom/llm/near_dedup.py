"""Near-duplicate detection by SuperMinHash.

Every shingle of a document walks through the signature in a random order of its own and offers its draw of step j, a number
in [j, j + 1), to the j-th place of that order; a place keeps its smallest offer. Draws of one shingle are correlated, which
gives signatures of less variance than independent hashes, and the walk stops as soon as no place can still get smaller.

Signatures are cut into bands; documents that share a band's values are candidates. Documents of one shingle set are one node.
In a bucket, every node is first tried against the one that shares most buckets, and links are grouped. Then only pairs of different
groups are left; buckets of many nodes compare these in blocks of bounded size, which hold nodes of similar set size. Nodes near their
bucket's centre carry the shingles in which they differ from it, from which two of them know what they share without their texts. A pair
is judged in its first common band only.
Every candidate whose signatures do not rule it out is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import apart, drop_rows, row_key, scratch, settle
from .words import GOLDEN, PLACE, U, Words, grams, mixed, text_slices

BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Signatures that agree in fewer places rule a pair of the similarity out: five standard deviations below 0.8.
SLACK = 5
#: Nodes of a bucket that are paired by lists; and of a block, when there are more.
SMALL, BLOCK = 24, 4096
PIECE = 1 << 16


def superminhash(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature of a set of distinct 64-bit hashes: step and draw of the smallest offer, by place."""
    best = np.full(places, np.iinfo(U).max, U)
    for first in range(0, len(x), PIECE):
        part = x[first : first + PIECE]
        rows, order, began = np.arange(len(part)), None, None
        for j in range(places):
            u = mixed(part + U(int(GOLDEN) * (j + 1) % 2**64))
            k = (U(j) + (((u & U(0xFFFFFFFF)) * U(places - j)) >> U(32))).astype(np.int64)
            if j == 0:
                began = place = k
            else:
                if order is None:  # the walk's first exchange, made up for
                    order = np.tile(np.arange(places, dtype=np.uint16), (len(part), 1))
                    order[:, 0] = began
                    order[rows, began] = 0
                place = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, j]
            np.minimum.at(best, place, (u >> U(32)) | U(j << 32))
            if best.max() < U((j + 1) << 32):
                break
    return best


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of a document's shingles; of fewer words, of the whole sequence."""
    return np.unique(grams(h, words if len(h) >= words else len(h))) if len(h) else h


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, band_place = Words(), np.arange(1, BANDS + 1).astype(U) * GOLDEN
        for batch in batches:
            n, a, b, bands, sigs = [], [], [], [], []
            for _, data, offsets in text_slices(batch.column(1)):
                _, _, doc, h = scan(data, offsets)
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    x = _shingles(h[bounds[i] : bounds[i + 1]], words)
                    n.append(len(x))
                    a.append(int(mixed(x ^ PLACE[1]).sum().view(np.int64)) if len(x) else 0)
                    b.append(int(mixed(x ^ PLACE[2]).sum().view(np.int64)) if len(x) else 0)
                    if len(x):
                        s = superminhash(x)
                        bands.append(mixed((mixed(s).reshape(BANDS, ROWS) * PLACE[:ROWS]).sum(axis=1) + band_place).view(np.int64))
                        sigs.append((mixed(s) & U(0xFFFF)).astype(np.uint16).tobytes())
                    else:
                        bands.append(np.zeros(0, np.int64))
                        sigs.append(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "sha", "n", "a", "b", "bands", "sig"],
            )

    return sign


def _agreement(similarity: float) -> int:
    return int(PLACES * similarity - SLACK * (PLACES * similarity * (1 - similarity)) ** 0.5)


def _alike(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that set sizes and signatures do not rule out."""
    least = _agreement(similarity)
    sides = [reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, PLACES) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= least))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked, missing, added): whether the shingle sets, made anew from the whole texts, reach the similarity; hashes of a's shingles that b lacks and of b's that a lacks."""

    def shingles(text: str | None) -> set:
        w = (text or "").encode().lower().split()
        return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, last_text, last, last_hashes = Words(), None, set(), None

        def hashes(text: str | None) -> np.ndarray:
            data = np.frombuffer((text or "").encode().lower(), np.uint8)
            return _shingles(scan(data, np.array([0, len(data)]))[3], words)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, linked, missing, added = batch.slice(first, 256), [], [], []
                for left, right in zip(part.column(2), part.column(3)):
                    left, right = left.as_py(), right.as_py()
                    if left != last_text:
                        last_text, last, last_hashes = left, shingles(left), hashes(left)
                    other, other_hashes = shingles(right), hashes(right)
                    shared = len(last & other)
                    linked.append(shared > 0 and 100 * shared >= percent * (len(last) + len(other) - shared))
                    missing.append(np.setdiff1d(last_hashes, other_hashes, True).view(np.int64))
                    added.append(np.setdiff1d(other_hashes, last_hashes, True).view(np.int64))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (missing, added)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), *lists], ["a", "b", "linked", "missing", "added"])

    sides = [texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    # By a last: its pairs come together, and its set is made once.
    joined = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(judge, "a long, b long, linked boolean, missing array<long>, added array<long>")


def _across(shared: DataFrame, labels: DataFrame, reps: DataFrame, tried: DataFrame, similarity: float, settle: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that share a bucket but no group yet."""
    entries = shared.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("key", "band", "rep", "centre", "members", F.coalesce("comp", "rep").alias("comp"))
    several = entries.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    entries = settle(entries.join(several, "key"), "entries")
    lists = entries.where(F.col("members") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "comp"))).alias("nodes"))
    small = (
        lists.select(F.posexplode("nodes").alias("i", "x"), "nodes")
        .select("x", F.explode(F.slice("nodes", F.col("i") + 2, SMALL)).alias("y"))
        .where("x.comp <> y.comp AND x.rep <> y.rep")
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    large = entries.where(F.col("members") > SMALL)
    if large.isEmpty():
        return small
    nodes = large.select("rep", "centre").distinct()
    apart = tried.select(F.col("a").alias("centre"), F.col("b").alias("rep"), "missing", "added")
    of_centre = reps.select(F.col("rep").alias("centre"), F.col("n").alias("n_centre"))
    sized = nodes.join(reps.select("rep", "n", "bands", "sig"), "rep").join(apart, ["centre", "rep"], "left").join(of_centre, "centre")
    sized = settle(sized.withColumn("own", F.col("rep") == F.col("centre")), "sized")
    # A pair of the similarity lies in one size class or in two adjacent ones.
    size_class = F.floor(0.999 * F.log("n") / float(-np.log(similarity))).cast("int")
    both = F.explode(F.array(F.col("size_class"), F.col("size_class") - 1)).alias("low")
    placed = large.join(reps.select("rep", size_class.alias("size_class")), "rep").select("key", "band", "rep", "centre", "comp", "size_class", both)
    counts = placed.groupBy("key", "low").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"), (F.min("comp") < F.max("comp")).alias("open"))
    counts = counts.where("open").drop("open")
    dealt = placed.join(counts, ["key", "low"]).withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    i, j, upper = F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("size_class") > F.col("low")).alias("upper")
    dealt = dealt.select("key", "low", i, j, "band", "rep", "centre", "comp", upper, "cut").join(sized, ["rep", "centre"])
    least = _agreement(similarity)

    def compare(table: pa.Table) -> pa.Table:
        rep, comp, n, upper, cut = (table.column(x).to_numpy() for x in ("rep", "comp", "n", "upper", "cut"))
        whole, own = table.column("n_centre")[0].as_py(), table.column("own").to_pylist()
        missing, added = ([set() if o else set(x) if x is not None else None for o, x in zip(own, table.column(c).to_pylist())] for c in ("missing", "added"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, PLACES)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        crossed, band, out = table.column("i")[0].as_py() != table.column("j")[0].as_py(), table.column("band")[0].as_py(), []

        def reaches(k: int, m: int) -> bool:
            shared = whole - len(missing[k] | missing[m]) + len(added[k] & added[m])
            return shared >= (similarity - 1e-9) * (n[k] + n[m] - shared)

        for k in range(len(rep) - 1):
            right = slice(k + 1, None)
            open_ = (comp[right] != comp[k]) & (rep[right] != rep[k]) & ~(upper[right] & upper[k]) & (np.minimum(n[right], n[k]) >= similarity * np.maximum(n[right], n[k]))
            if crossed:
                open_ &= cut[right] != cut[k]
            at = np.flatnonzero(open_) + k + 1
            # The first band of equal values, not of equal cuts of the signature, which can agree by chance.
            first = (bands[at] == bands[k]).argmax(axis=1)
            at = at[((sig[at] == sig[k]).sum(axis=1) >= least) & (first == band)]
            if missing[k] is not None:
                at = np.array([m for m in at if missing[m] is None or reaches(k, m)], np.int64)
            out += zip(np.minimum(rep[at], rep[k]), np.maximum(rep[at], rep[k]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return small.unionByName(dealt.groupBy("key", "low", "i", "j").applyInArrow(compare, "a long, b long")).distinct()


def _one_id(signed: DataFrame, reps: DataFrame, work: scratch) -> DataFrame:
    """Links (a, b) between the nodes of an id that repeats with other sets."""
    own = F.struct("a", "b", "n")
    repeated = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(own) < F.max(own)).alias("several")).where("several").select("doc_id")
    ids = signed.join(repeated, "doc_id").select("doc_id", "a", "b", "n")
    nodes = work(ids.join(reps.select("a", "b", "n", "rep"), ["a", "b", "n"]).select("doc_id", "rep").distinct(), "nodes-of-ids")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))


def _keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, sha): ids that are null or repeat are told apart by their texts' hashes."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _sha(F.col(text)).alias("sha"))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _linked(rows: DataFrame, words: int, percent: int, work: scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of _keyed rows: signed rows; ids that are null or repeat; nodes, which are numbered sets with their first row's id and sha; links (a, b) of nodes. All are tables of work."""
    similarity = percent / 100
    signed = work(rows.select("doc_id", "text", "sha").mapInArrow(_signer(words), "doc_id long, sha binary, n long, a long, b long, bands array<long>, sig binary"), "signed")
    odd = work(signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("doc_id IS NULL OR times > 1").select(F.col("doc_id").alias("odd_id")), "odd-ids")
    # Nodes: sets by a fingerprint of 128 bits over all their shingles, and their number. A set's first row is the one of the smallest id, without an id the last.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("first_id"), F.col("sha").alias("first_sha"))
    sets = signed.where("n > 0").groupBy("a", "b", "n").agg(F.min(first).alias("first"), F.first(F.struct("bands", "sig")).alias("s"))
    reps = work(sets.select("a", "b", "n", F.monotonically_increasing_id().alias("rep"), "first", "s.bands", "s.sig"), "nodes")
    entries = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = work(entries.join(buckets, "key"), "buckets")
    in_buckets = work(reps.join(shared.select("rep").distinct(), "rep").select("rep", "first.first_id", "first.first_sha"), "in-buckets")
    texts = work(_texts(rows, in_buckets, odd), "texts")
    # The bucket's centre, which in a group of variants is the one nearest to all: every other member is tried against it.
    degrees = shared.groupBy("rep").agg(F.sum("members").alias("degree"))
    centres = shared.join(degrees, "rep").groupBy("key").agg(F.max(F.struct("degree", -F.col("rep"))).alias("m")).select("key", (-F.col("m.col2")).alias("centre"))
    centred = work(shared.join(centres, "key"), "centred")
    stars = work(centred.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    tried = work(_confirmed(_alike(stars, reps, similarity), texts, words, percent), "star-links")
    links = tried.where("linked").select("a", "b")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _across(centred, components(links, work), reps, tried, similarity, work).join(done, ["a", "b"], "left_anti")
    more = work(_confirmed(_alike(rest, reps, similarity), texts, words, percent).where("linked").select("a", "b"), "links")
    return signed, odd, reps, links.unionByName(more)


def _texts(rows: DataFrame, nodes: DataFrame, odd: DataFrame) -> DataFrame:
    """(rep, text): one text of each of nodes (rep, first_id, first_sha). Only texts of these are shuffled."""
    _, met = apart(rows, row_key(rows["doc_id"], rows["sha"]), nodes.select(row_key(F.col("first_id"), F.col("first_sha"))))
    found = met.join(nodes, met["doc_id"].eqNullSafe(nodes["first_id"]) & (met["sha"] == nodes["first_sha"])).select("rep", "text")
    return found if odd.isEmpty() else found.dropDuplicates(["rep"])


def _components(reps: DataFrame, links: DataFrame, work: scratch) -> DataFrame:
    """(a, b, n, comp, first) of each node: its component's number and its first row."""
    labels = components(links, work)
    return reps.select("a", "b", "n", "rep", "first").join(labels, reps["rep"] == labels["id"], "left").select("a", "b", "n", F.coalesce("comp", "rep").alias("comp"), "first")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `words` words (A-Z lowered, parted by white space), or all its words as one
    if it has fewer. Documents are linked if 100 times the common shingles are at least `percent` times all of both, and
    component_id is the smallest doc_id that links reach; kept: its own. Null, empty and blank texts have no shingles and no links.
    Rows of one id are one node. Rows without an id are nodes by their texts: they link like others, and one of a component is
    kept only if no row of it has an id. doc_id is an integer; texts of any length are read whole; other columns are not read, whatever
    their names; an empty table gives no rows.
    """
    with scratch(docs.sparkSession, "near-copies") as work:
        signed, _, reps, links = _linked(_keyed(docs, doc_id, text), words, percent, work)
        of_set = work(_components(reps, links.unionByName(_one_id(signed, reps, work)), work), "of-set")
        firsts = work(of_set.groupBy("comp").agg(F.min("first").alias("top")), "firsts")
        of_set = of_set.join(firsts, "comp").select("a", "b", "n", "top")
        known = signed.where("doc_id IS NOT NULL").select("doc_id", "n", "a", "b").join(of_set, ["a", "b", "n"], "left")
        component = F.coalesce("top.first_id", "doc_id")
        out = known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
        # Rows without an id and of one text are counted, so that one of them can be told from the others.
        nameless = signed.where("doc_id IS NULL").groupBy("sha", "n", "a", "b").agg(F.count(F.lit(1)).alias("times")).join(of_set, ["a", "b", "n"], "left")
        nameless = nameless.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        alone = (F.col("n") == 0) | (F.col("top.no_id") & (F.col("sha") == F.col("top.first_sha")) & (F.col("copy") == 1))
        nameless = nameless.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("top.first_id").alias("component_id"), alone.alias("kept"))
        return settle(out.unionByName(nameless), "near-copies")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with one row of each group, the one of the smallest doc_id. Each row is judged by its own text, whether its id is null, repeated or neither.

    Texts are read whole in their tasks; of the rows that stay, only those that may be among the dropped ones are shuffled.
    """
    with scratch(docs.sparkSession, "near-copies") as work:
        signed, _, reps, links = _linked(_keyed(docs), 5, 80, work)
        kept = work(_components(reps, links, work).groupBy("comp").agg(F.min("first").alias("top")).select("top.first_id", "top.first_sha"), "kept")
        rows = work(signed.where("n > 0").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("times")), "rows")
        is_kept = rows["doc_id"].eqNullSafe(kept["first_id"]) & (rows["sha"] == kept["first_sha"])
        names = [F.col("doc_id").alias("dropped_id"), F.col("sha").alias("dropped_sha")]
        dropped = settle(rows.join(kept, is_kept, "left_anti").select(*names), "dropped")
        # Of rows that repeat an id and a text, one.
        repeated = settle(rows.where("times > 1").join(kept, is_kept, "left_semi").select(*names), "repeated")
    return drop_rows(docs, _sha(docs["text"]), dropped, repeated)
