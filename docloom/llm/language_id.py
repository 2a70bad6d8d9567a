"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted by its
place in the n-gram; a language's prototype and a document bundle (add) the vectors of all their n-grams, and a document
gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle
from .words import GOLDEN, U, mixed

DIMENSIONS, N = 2048, 3
#: n-grams whose vectors a task keeps.
MOST_KEPT = 40_000
#: Texts whose common n-grams are added up at once.
TOGETHER = 256
#: Stands for every run of characters that are no letters.
GAP = 0
NONE = "und"


class Profiles:
    """n-gram counts of texts and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N):
        self.dimensions, self.n, self.vectors, self.place = dimensions, n, np.zeros((0, dimensions), np.int8), {}
        #: Of code points: 0 not met yet, 1 no letter, 2 a letter.
        self.kinds = np.zeros(0x110000, np.int8)

    def code_points(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, with one GAP for each run of anything else and at both ends."""
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[x]
        if not kind.all():
            for k in np.unique(x[kind == 0]):
                self.kinds[k] = 2 if chr(k).isalpha() else 1
            kind = self.kinds[x]
        letter = kind == 2
        x = np.concatenate([[GAP], np.where(letter, x, GAP), [GAP]]).astype(U)
        return x[np.concatenate([[True], (x[1:] != GAP) | (x[:-1] != GAP)])]

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, 21 bits a letter, and how often each occurs."""
        x = self.code_points(text or "")
        if len(x) < 3:  # no letter
            return np.zeros(0, U), np.zeros(0, np.int64)
        m = max(1, len(x) - self.n + 1)
        g = np.zeros(m, U)
        for i in range(self.n):
            g = (g << U(21)) | x[i : i + m]
        return np.unique(g, return_counts=True)

    def letter(self, code: int) -> np.ndarray:
        """A letter's vector: bits of hashes of the letter and the dimension."""
        return ((mixed(U((code + 1) * int(GOLDEN) % 2**64) + np.arange(self.dimensions, dtype=U)) >> U(17)) & U(1)).astype(np.int8) * 2 - 1

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The places in self.vectors of distinct n-grams; vectors of new ones are made."""
        new = [g for g in grams.tolist() if g not in self.place]
        if new and len(self.place) + len(new) > MOST_KEPT:  # forgets vectors, which are made again when needed
            self.place, new = {}, grams.tolist()
        if new:
            made = np.ones((len(new), self.dimensions), np.int8)
            for i in range(self.n):
                codes, back = np.unique([(g >> (21 * (self.n - 1 - i))) & 0x1FFFFF for g in new], return_inverse=True)
                made *= np.stack([np.roll(self.letter(int(c)), i + 1) for c in codes])[back]
            first = len(self.place)
            self.place.update(zip(new, range(first, first + len(new))))
            if first + len(new) > len(self.vectors):
                larger = np.empty((2 * (first + len(new)), self.dimensions), np.int8)
                larger[:first] = self.vectors[:first]
                self.vectors = larger
            self.vectors[first : first + len(new)] = made
        return np.fromiter((self.place[g] for g in grams.tolist()), np.int64, len(grams))

    def _sum(self, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        # Whole numbers: single precision is exact below 2**24.
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        for i in range(0, len(places), 512):
            total += counts[i : i + 512].astype(kind) @ self.vectors[places[i : i + 512]].astype(kind)
        return total

    def _sums(self, counted: list[tuple[np.ndarray, np.ndarray]], places: np.ndarray) -> Iterator[np.ndarray | None]:
        """The vector of each text, given where its n-grams are among places. n-grams that many of the texts have are multiplied for TOGETHER of them at once; whole numbers, so the sums are the same."""
        often = np.bincount(np.concatenate([at for at, _ in counted]), minlength=len(places)) >= max(2, len(counted) // 32)
        column, common = np.cumsum(often) - 1, places[often]
        for first in range(0, len(counted), TOGETHER):
            part = counted[first : first + TOGETHER]
            kind = np.float32 if max(c.sum() for _, c in part) < 1 << 24 else np.float64
            matrix, total = np.zeros((len(part), len(common)), kind), np.zeros((len(part), self.dimensions))
            for row, (at, c) in zip(matrix, part):
                row[column[at[often[at]]]] = c[often[at]]
            for i in range(0, len(common), 1024):
                total += matrix[:, i : i + 1024] @ self.vectors[common[i : i + 1024]].astype(kind)
            for own, (at, c) in zip(total, part):
                yield own + self._sum(c[~often[at]], places[at[~often[at]]]) if len(at) else None

    def bundles_of(self, names: list[str], texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
        """The sum of the vectors of each name's texts, if these have letters. Bundles are sums, so n-grams are added up before their vectors are."""
        grams: dict[str, list] = {}
        for name, text in zip(names, texts):
            g, c = self.count(text)
            if len(g):
                grams.setdefault(name, []).append((g, c))
        for name, parts in grams.items():
            g, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            c = np.bincount(back, np.concatenate([x for _, x in parts]))
            total = np.zeros(self.dimensions)
            for i in range(0, len(g), MOST_KEPT):
                total += self._sum(c[i : i + MOST_KEPT], self.rows(g[i : i + MOST_KEPT]))
            yield name, total

    def bundles(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Each text's vector; None without letters."""
        counted = [self.count(x) for x in texts]
        every = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, U)
        for first in range(0, max(1, len(every)), MOST_KEPT):  # once, but for texts of very many n-grams
            some = every[first : first + MOST_KEPT]
            places = self.rows(some)
            if len(some) == len(every):
                yield from self._sums([(np.searchsorted(every, g), c) for g, c in counted], places)
                return
            if first == 0:
                sums = [np.zeros(self.dimensions) if len(g) else None for g, _ in counted]
            for i, (g, c) in enumerate(counted):
                own = (g >= some[0]) & (g <= some[-1])
                if own.any():
                    sums[i] += self._sum(c[own], places[np.searchsorted(some, g[own])])
        yield from sums


def _slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list]]:
    texts, size, first = [], 0, 0
    for i, x in enumerate(column):
        x = x.as_py()
        texts.append(x)
        size += len(x or "")
        if size >= most:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def learn_prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, n: int = N, most: int = 1000) -> dict[str, np.ndarray]:
    """Each language's bundle over all rows of labelled; rows without text or language teach nothing. Its size: languages times dimensions.

    More than `most` values of lang are an error: they are no languages.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions, n), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, texts in _slices(batch.column(0)):
                for name, v in profiles.bundles_of(names[first : first + len(texts)], texts):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        yield as_batch(sums)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[name] = sums.get(name, 0) + v.values.to_numpy()
        yield as_batch(sums)

    def as_batch(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "sums"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # Partitions' sums meet in 32 tasks, then by dimension: whole numbers, so any order gives the same.
    partial = rows.mapInArrow(bundle, "lang string, sums array<long>").repartition(32).mapInArrow(combine, "lang string, sums array<long>")
    partial = settle(partial, "bundles")
    if (languages := partial.select("lang").distinct().count()) > most:
        raise ValueError(f"{languages} values of lang, at most {most} languages")
    total = partial.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, i, x in total.collect():
        out.setdefault(name, np.zeros(dimensions))[i] = x
    return {k: out[k] for k in sorted(out)}


def _predictor(spark: SparkSession, prototypes: dict[str, np.ndarray], dimensions: int, n: int):
    """A function from a column of texts to names and scores."""
    names = list(prototypes)
    matrix = np.array([v / max(1e-30, float(np.linalg.norm(v))) for v in prototypes.values()]).reshape(-1, dimensions)
    shared = spark.sparkContext.broadcast(matrix)

    def predict(column: pa.Array, profiles: Profiles) -> tuple[list[str], list[float]]:
        found, scores = [], []
        for _, texts in _slices(column):
            for v in profiles.bundles(texts):
                cosines = shared.value @ v / max(1e-30, float(np.linalg.norm(v))) if v is not None and names else [0.0]
                best = int(np.argmax(cosines))
                found.append(names[best] if v is not None and names else NONE)
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
        return found, scores

    return predict


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, n: int = N) -> DataFrame:
    """For each row: doc_id, lang_pred and score, the cosine (0 if negative) with the nearest prototype; ties go to the first name.

    A text that is null or has no letter is `und` with score 0, and so is every text if there is no prototype. A text of any length is
    read whole, in its task. Rows that repeat an id are judged each; other columns are not read, whatever their names; an empty table gives no rows.
    """
    predict = _predictor(docs.sparkSession, prototypes, dimensions, n)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions, n)
        for batch in batches:
            found, scores = predict(batch.column(1), profiles)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(judge, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, n: int = N, least: float | None = None) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns and in one pass over the texts.

    Texts without letters go, and those whose cosine with the nearest prototype is below `least`. With `least`, rows that stay without a
    lang get the predicted one; a given lang is not changed. Each row is judged by its own text; an empty table gives no rows.
    """
    predict = _predictor(docs.sparkSession, prototypes, dimensions, n)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions, n)
        for batch in batches:
            found, scores = predict(batch.column(batch.schema.get_field_index("text")), profiles)
            stays = pa.array([x != NONE and (least is None or y >= least) for x, y in zip(found, scores)], pa.bool_())
            if least is not None and (at := batch.schema.get_field_index("lang")) >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(batch.column(at), pa.array(found, batch.schema.field(at).type)))
            yield batch.filter(stays)

    return docs.mapInArrow(keep, docs.schema)


def by_chance(dimensions: int = DIMENSIONS) -> float:
    """Three standard deviations of the cosine of vectors that have nothing in common: a text below it is no nearer to any language than chance."""
    return 3 / dimensions**0.5
