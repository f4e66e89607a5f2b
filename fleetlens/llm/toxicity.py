"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is logistic in its distinct words and their beginnings; a document is toxic if any sentence is,
so its score is the noisy-or of theirs. Training sees document labels only: the gradient of the noisy-or gives each
sentence its share of the blame, and the sentences that carry it are then located by their own scores.

Defined results: a null or empty text is one empty sentence; labels that are null are not used; repeated rows come
out each, and an id counts once in training however many rows it has; without both labels in the sample every score
is 0 (no evidence); an empty table gives no rows; columns other than id and text are never read for a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import cut
from fleetlens.llm.sampling import fold, sample_ids
from fleetlens.session import ship_package

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
BITS = 18
CACHED = 300_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    found = [word]
    if len(word) > 5:
        found += [word[:4] + "*", word[:5] + "*"]
    return tuple(zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in found)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; an empty text has one."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from a text to [(start, end, score)] of its sentences and the document's score."""
        known: dict[str, float] = {}
        weights, bias = self.weights, self.bias

        def weight(word: str) -> float:
            if len(known) > CACHED:  # starts anew, so that its size is bounded
                known.clear()
            w = known[word] = float(sum(weights[i] for i in word_features(word)))
            return w

        def score(text: str) -> tuple[list[tuple[int, int, float]], float]:
            spans = sentences(text)
            low = text.lower()
            if len(low) != len(text):  # a letter whose lower case is longer: sentence by sentence
                low = None
            z = np.empty(len(spans))
            for n, (a, b) in enumerate(spans):
                words = WORD.findall(low, a, b) if low is not None else WORD.findall(text[a:b].lower())
                z[n] = bias + sum(known[w] if w in known else weight(w) for w in set(words))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            total = -np.expm1(-np.logaddexp(0, np.clip(z, -30, 30)).sum())
            return [(a, b, float(q)) for (a, b), q in zip(spans, p)], float(min(1.0, max(0.0, total)))

        return score


def _bag(text: str, kept: np.ndarray) -> bytes:
    """The kept features of each sentence as 32-bit integers; alike sentences once: minus their number, then the
    features. What no feature is kept of is one such kind, so a bag grows with the evidence, not with the text."""
    kinds: Counter[tuple[int, ...]] = Counter()
    low = text.lower()
    for a, b in sentences(low):
        words = set(WORD.findall(low, a, b))
        kinds[tuple(sorted(f for w in words for f in word_features(w) if kept[f]))] += 1
    out = [x for kind, n in sorted(kinds.items()) for x in (-n, *kind)]
    return np.array(out, np.int32).tobytes()


@dataclass(frozen=True)
class Bags:
    """Kinds of sentences of all documents: the document and the number of each, and the kind of each feature's place."""

    document: np.ndarray
    times: np.ndarray
    at: np.ndarray
    feature: np.ndarray
    used: np.ndarray

    @staticmethod
    def of(bags: list[bytes]) -> Bags:
        flat = np.frombuffer(b"".join(bags), np.int32)
        sizes = np.array([len(b) // 4 for b in bags])
        begins = flat < 0
        document = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)[begins]
        at = (np.cumsum(begins, dtype=np.int32) - 1)[~begins]
        used, feature = np.unique(flat[~begins], return_inverse=True)
        return Bags(document, -flat[begins].astype(np.int64), at, feature, used)


def gradient(bags: Bags, toxic: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """The mean loss of the documents' noisy-or, and its derivatives by the used features' weights and by the bias."""
    n, documents = len(bags.document), len(toxic)
    z = bias + np.bincount(bags.at, weights[bags.feature], n)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # minus the log of no sentence being toxic
    none = np.bincount(bags.document, bags.times * np.logaddexp(0, z), documents)
    some = np.maximum(-np.expm1(-none), 1e-12)
    loss = np.where(toxic, -np.log(some), none).mean()
    blame = np.where(toxic, -np.exp(-none) / some, 1.0) / documents
    grad_z = blame[bags.document] * p * bags.times
    return float(loss), np.bincount(bags.feature, grad_z[bags.at], len(bags.used)), float(grad_z.sum())


def fit(
    bags: list[bytes], toxic: np.ndarray, evidence: np.ndarray, *, passes: int = 150, speed: float = 0.05,
    penalty: float = 0.1,
) -> Model | None:
    """A model from bags of sentences, document labels and the features' log ratios, at which weights start; full
    passes of Adam then fit the noisy-or. None where one of the labels is missing."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    y, held = toxic.astype(bool), Bags.of(bags)
    weights, bias = evidence[held.used].astype(np.float64), -6.0
    m, v, mb, vb = np.zeros(len(weights)), np.zeros(len(weights)), 0.0, 0.0
    for step in range(1, passes + 1):
        _, grad, grad_bias = gradient(held, y, weights, bias)
        grad = grad + penalty * weights / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        rate = speed * min(1, 2 * (1 - step / (passes + 1)))
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weights -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        bias -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    full = np.zeros(1 << BITS, np.float32)
    full[held.used] = weights
    return Model(full, float(bias))


def _evidence(sampled: DataFrame, least: float) -> np.ndarray:
    """Log ratio of smoothed document shares, toxic to other, of each feature; 0 where it is below ``least``, as such a
    feature is no evidence for a noisy-or. Documents are counted by Spark; what is left reaches the driver, at most
    one row per feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = np.zeros((2, 1 << BITS), np.int64)
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                words = set(WORD.findall((text.as_py() or "").lower()))
                tally[label, list({f for w in words for f in word_features(w)})] += 1
            there = np.flatnonzero(tally.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array(tally[1, there]), pa.array(tally[0, there])],
                names=["feature", "toxic", "other"],
            )

    n = sampled.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    out = np.zeros(1 << BITS)
    if not n["n"] or n["toxic"] in (0, n["n"]):
        return out
    share = n["toxic"] / n["n"]
    prior_documents = max(4.0, n["n"] / 1000)  # without evidence: so many documents at the usual share
    ratio = F.log(
        (F.sum("toxic") + prior_documents * share) / (F.sum("other") + prior_documents * (1 - share))
        * (1 - share) / share
    )
    counted = sampled.select("label", "text").mapInArrow(count, "feature int, toxic long, other long").groupBy("feature")
    for r in counted.agg(ratio.alias("ratio")).where(F.col("ratio") >= least).collect():
        out[r["feature"]] = r["ratio"]
    return out


def gathered(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 4, held_out: int = 2, max_labelled: int = 24_000, max_bytes: int = 64 << 20, least: float = 1.5,
) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bags and labels of the sampled documents and the features' evidence: what the driver holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = marked.where((fold("doc_id", folds) != held_out) & F.col("label").isin(0, 1))
    ids = sample_ids(usable, max_labelled, 3)
    # the sample's bound is a parameter, so it may be sent to every task instead of shuffling all texts
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label")
    sampled = cut(rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled-texts")
    evidence = _evidence(sampled, least)
    kept = evidence > 0

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_bag(t.as_py() or "", kept) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), found], names=["doc_id", "label", "bag"])

    kind = sampled.schema["doc_id"].dataType.simpleString()
    bags = cut(sampled.mapInArrow(bag, f"doc_id {kind}, label int, bag binary"), "labelled-bags")
    # sizes of at most max_labelled documents meet in one window
    order = Window.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    so_far = bags.select("doc_id", F.sum(F.length("bag")).over(order).alias("so_far")).where(F.col("so_far") <= max_bytes)
    taken = bags.join(so_far, "doc_id").orderBy("so_far", "doc_id").collect()
    return [bytes(r["bag"]) for r in taken], np.array([r["label"] for r in taken], dtype=np.int64), evidence


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """Fits on at most ``max_labelled`` documents outside the held-out fold, taken by hash of their ids among labelled
    ones, whole, as far as their bags hold ``max_bytes`` together (see ``gathered``). An id with several rows counts
    once, with one of its texts. Scoring has no bounds."""
    ship_package(docs.sparkSession)
    return fit(*gathered(docs, labels, **bounds))


_RESULT = "struct<score:double,offending:array<struct<begin:bigint,end:bigint,score:double>>>"


def scored(text: Column, model: Model | None, threshold: float = 0.3) -> Column:
    """A whole text's ``score`` and its ``offending`` sentences, as a struct; nothing but the text goes through Python."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def find(texts: pa.Array) -> pa.Array:
        scorer = model.scorer() if model is not None else lambda text: ([], 0.0)
        totals, found = [], []
        for text in texts:
            spans, total = scorer(text.as_py() or "")
            totals.append(total)
            found.append([{"begin": a, "end": b, "score": p} for a, b, p in spans if p >= threshold])
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.float64()), pa.array(found, pa.list_(span))], names=["score", "offending"])

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, _RESULT)(text)


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of the documents, ``score``, and ``offending``: the sentences (character offsets) that alone reach
    the threshold. These two replace columns of their names."""
    ship_package(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "offending")]
    found = docs.select(F.struct(*kept).alias("doc"), scored(F.col(text_col), model, threshold).alias("found"))
    return found.select("doc.*", "found.*")
