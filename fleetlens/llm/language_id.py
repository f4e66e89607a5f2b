"""Language of texts by the nearest of several centroids of each language.

A text is its character n-grams of one to three letters within words (lower case, everything that is no letter as one
blank), hashed to ``SLOTS`` places, weighted by 1 + log of their number and by their inverse document frequency, and
scaled to length one. The training texts of each language are clustered by cosine (spherical k-means), so that a
language of several scripts, registers or kinds of page has a centroid for each. A text is of the language of the
centroid at the smallest distance (1 - cosine); it is rejected if that distance is larger than the centroid's own texts
allow, by their mean and spread.

Training reads at most ``max_labelled`` labelled texts, taken by hash and evenly from the languages; their vectors are
stored, and every sum over them is made by Spark. The driver holds the centroids, languages * ``clusters`` * ``SLOTS``
numbers.

Defined results: a text that is null or has no letter is of ``und`` with score 0, and rejected; without any labelled text all
texts are; rows whose language is null are not learned from; repeated rows come out each and count each in
training; texts of any length are read whole; an empty table gives no rows; a label is never read for a prediction. All
columns of the documents are kept, and those added replace any of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import cut
from fleetlens.llm.sampling import fold
from fleetlens.session import ship_package

SLOTS = 1 << 14
GRAMS = 3
UNKNOWN = "und"
STRETCH = 1 << 20
# Odd 64-bit constants for mixing, one per length of n-gram.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """How often each slot is hit by an n-gram of a run of code points in which 0 stands for what is no letter."""
    wide, slots = codes.astype(np.uint64), []
    for n in range(1, GRAMS + 1):
        count = len(wide) - n + 1
        if count <= 0:
            break
        mixed = np.full(count, ODD[n - 1])
        for k in range(n):
            mixed = (mixed ^ wide[k : count + k]) * ODD[0]
            mixed ^= mixed >> np.uint64(29)
        # the middle character of an n-gram, of two the second, is a letter
        inner = codes[n // 2 : n // 2 + count] != 0
        slots.append((mixed[inner] >> np.uint64(64 - 14)).astype(np.int64))
    return np.bincount(np.concatenate(slots), minlength=SLOTS)


def counts(text: str | None) -> np.ndarray | None:
    """How often each slot's n-grams occur in the whole text; None without a letter."""
    text = text or ""
    letter = _is_letter()
    total, some, tail = np.zeros(SLOTS, np.int64), False, np.zeros(1, np.uint32)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le"), np.uint32)
        codes = np.where(letter[codes], codes, 0).astype(np.uint32)
        some = some or bool(codes.any())
        last = at + STRETCH >= len(text)
        run = np.concatenate([tail, codes, np.zeros(1, np.uint32)] if last else [tail, codes])
        single = np.concatenate([[True], (run[1:] != 0) | (run[:-1] != 0)])  # runs of blanks as one
        run = run[single]
        total += _grams(run)
        if not last:
            # n-grams of the last two characters alone are in both stretches: they are taken out of one
            tail = run[-(GRAMS - 1) :]
            total -= _grams(tail)
    return total if some else None


def unit(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weighted vector of length one."""
    there = np.flatnonzero(found)
    weights = (1 + np.log(found[there])) * idf[there]
    x = np.zeros(len(found), idf.dtype)
    x[there] = weights / max(float(np.linalg.norm(weights)), 1e-12)
    return x


@dataclass(frozen=True)
class Model:
    """``languages`` names the language of each row of ``centroids``; a text farther than ``reach`` is rejected."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ unit(found, self.idf)
        best = int(cosine.argmax())
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(1 - cosine[best] > self.reach[best])


def _stored(docs: DataFrame) -> DataFrame:
    """(lang, order, slots, n): the counts of each text that has a letter, as lists of its slots."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, slots, numbers = [], [], []
            for row, text in enumerate(batch.column("text")):
                found = counts(text.as_py())
                if found is not None:
                    there = np.flatnonzero(found)
                    kept.append(row), slots.append(there.astype(np.int16).tobytes())
                    numbers.append(found[there].astype(np.int32).tobytes())
            rows = batch.select(["lang", "order"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(slots, pa.binary()), pa.array(numbers, pa.binary())],
                names=["lang", "order", "slots", "n"])

    return docs.select("lang", "order", "text").mapInArrow(build, "lang string, order long, slots binary, n binary")


def _dense(slots: bytes, n: bytes) -> np.ndarray:
    x = np.zeros(SLOTS, np.int64)
    x[np.frombuffer(slots, np.int16)] = np.frombuffer(n, np.int32)
    return x


def _added(rows: DataFrame) -> DataFrame:
    """(centroid, n, far, far2, total): the rows of partial sums added per centroid."""

    def add(parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t.as_buffer(), np.float64) for t in parts.column("total")], axis=0)
        plain = {c: pa.array([sum(parts.column(c).to_pylist())]) for c in ("n", "far", "far2")}
        return pa.table({"centroid": parts.column("centroid").slice(0, 1), **plain, "total": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy("centroid").applyInArrow(add, "centroid int, n long, far double, far2 double, total binary")


_PARTS = "centroid int, n long, far double, far2 double, total binary"


def _partial(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)],
        names=["centroid", "n", "far", "far2", "total"])


def _document_frequencies(stored: DataFrame) -> tuple[int, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(SLOTS, np.float64)
        for batch in batches:
            n += batch.num_rows
            for slots in batch.column("slots"):
                total[np.frombuffer(slots.as_buffer(), np.int16)] += 1
        yield _partial([(0, n, 0.0, 0.0, total.tobytes())])

    row = _added(stored.select("slots").mapInArrow(count, _PARTS)).first()
    return (row["n"], np.frombuffer(row["total"], np.float64)) if row else (0, np.zeros(SLOTS))


def _round(stored: DataFrame, languages: list[str], centroids: np.ndarray, idf: np.ndarray):
    """Sums and distances of the texts per centroid of their own language that is nearest."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for c, language in enumerate(languages):
            own[language] = np.append(own.get(language, np.empty(0, int)), c)
        n, far, far2 = (np.zeros(len(languages)) for _ in range(3))
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for language, slots, number in zip(*(batch.column(c).to_pylist() for c in ("lang", "slots", "n"))):
                x = unit(_dense(slots, number), idf)
                cosine = centroids[own[language]] @ x
                c, away = int(own[language][cosine.argmax()]), 1 - float(cosine.max())
                n[c] += 1
                far[c], far2[c] = far[c] + away, far2[c] + away * away
                total[c] = total.get(c, 0.0) + x
        yield _partial([(c, int(n[c]), far[c], far2[c], x.tobytes()) for c, x in total.items()])

    return _added(stored.select("lang", "slots", "n").mapInArrow(assign, _PARTS)).collect()


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, evenly from the languages, the first of each by hash of the row."""
    # a language's rows are thinned by their hash before any are ordered, so none of them is one task's
    # stored first, so that its size is known and texts are not shuffled where it is small
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "language-sizes")
    languages = max(1, sizes.count())
    share = F.lit(most / languages) / F.col("rows")
    order = F.xxhash64(F.lit(13), "doc_id", F.xxhash64("text"))
    thinned = labelled.withColumn("order", order).join(sizes, "lang").where(
        F.pmod("order", F.lit(1 << 20)) < share * (1 << 20))
    return thinned.orderBy("order", "lang").limit(most)


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3,
    held_out: int = 1, clusters: int = 4, rounds: int = 4, max_labelled: int = 12_000, spread: float = 5.0,
) -> Model:
    """Learns from labelled documents outside the held-out fold."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    stored = cut(_stored(_sample(labelled, max_labelled)), "language-texts")
    n, frequency = _document_frequencies(stored)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # one text for each centroid to begin with, the first by hash; the sample is bounded
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "slots", "n"))
    seeds = stored.dropDuplicates(["slots", "n", "lang"]).withColumn("place", place).where(F.col("place") <= clusters)
    seeds = sorted(seeds.collect(), key=lambda r: (r["lang"], r["place"]))
    languages = [r["lang"] for r in seeds]
    centroids = np.array([unit(_dense(r["slots"], r["n"]), idf) for r in seeds]).reshape(len(seeds), SLOTS)
    reach = np.zeros(len(seeds))
    for step in range(rounds + 1):
        for r in _round(stored, languages, centroids, idf) if len(seeds) else ():
            c = r["centroid"]
            mean = r["far"] / r["n"]
            reach[c] = mean + spread * np.sqrt(max(0.0, r["far2"] / r["n"] - mean * mean)) + 1e-6
            if step < rounds:  # the last round only measures
                total = np.frombuffer(r["total"], np.float64)
                centroids[c] = total / max(float(np.linalg.norm(total)), 1e-12)
    return Model(languages, centroids.astype(np.float32), idf.astype(np.float32), reach)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents with ``nearest`` (the nearest centroid's language), ``lang_score`` (its cosine), ``rejected`` and
    ``language``: the nearest, or ``und`` where the text is rejected."""
    ship_package(docs.sparkSession)
    added = ("nearest", "lang_score", "rejected", "language")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]

    def find(text: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in text]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
             pa.array([f[2] for f in found], pa.bool_())], names=["nearest", "lang_score", "rejected"])

    find.__annotations__ = {"text": pa.Array, "return": pa.Array}
    find = F.arrow_udf(find, "struct<nearest:string,lang_score:double,rejected:boolean>")
    found = docs.select(F.struct(*kept).alias("doc"), find(F.col(text_col)).alias("found"))
    language = F.when(F.col("found.rejected"), UNKNOWN).otherwise(F.col("found.nearest"))
    return found.select("doc.*", "found.*", language.alias("language"))
