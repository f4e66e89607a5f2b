"""Quality by positive-unlabelled learning: trusted positives against unlabelled text and an estimated class prior.

No negative label is used. A first model tells positives from unlabelled text; on a part that it has not seen,
the top scores at which the ratio of unlabelled to positive shares is smallest estimate the prior (the share of
positives in unlabelled text). The final model, a small network over character and word statistics of whole
texts, minimises the non-negative unbiased risk: prior times the positives' loss, plus the unlabelled loss as
negatives less the positives' part of it, where a negative estimate of the latter is pushed back up.

Defined results: null and empty texts have the statistics of no characters and are scored like any other;
labels of null id or other than 1 are not used; repeated rows come out each, and an id counts once in training however
many rows it has; without any positive every score
is 0.5; an empty table gives no rows; columns other than id and text are never read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.sampling import fold, sample_ids
from fleetlens.session import ship_package

N_PLAIN = 24
N_FEATURES = N_PLAIN + 96


def features(text: str) -> np.ndarray:
    """Statistics of a whole text: kinds of characters, words, their repetition, lines, and each ASCII character."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    total = max(1.0, counts.sum())
    words = text.split()
    n = max(1, len(words))
    tally = Counter(words)
    most = max(tally.values(), default=0)
    ends = Counter(w[-1] for w in words)
    run, longest, same = 1, 1, 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        same += a == b
        longest = max(longest, run)
    lines = text.split("\n")
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    letters = max(1.0, counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum())
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    plain = [
        np.log1p(total), np.log1p(len(words)), counts[65:91].sum() / letters, counts[48:58].sum() / total,
        symbols / total, counts[128:].sum() / total, counts[32] / total, counts[10] / total, lengths.mean(),
        lengths.std(), len(tally) / n, most / n, same / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        sum(not e.isalnum() for e in ends.elements()) / n, sum(w.isupper() for w in words) / n,
        sum(len(w) == 1 for w in words) / n, sum(not any(c.isalpha() for c in w) for w in words) / n,
        len(tally) / n**0.5, sum(c.isalnum() is False for w in words for c in w[:1]) / n,
        float(not words), (same / n) ** 0.5, np.log(longest),
    ]
    return np.concatenate([plain, np.sqrt(counts[32:128] / total)])


@dataclass(frozen=True)
class Model:
    """Standardisation and the network's weights; ``prior`` is the estimated share of positives. ``at`` and ``to``
    map the network's output to how likely a text is a positive."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float
    at: np.ndarray
    to: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.interp(_forward(self.weights, z)[1], self.at, self.to)


def _forward(weights, z):
    hidden = np.tanh(z @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3][0]


def risk_gradient(out: np.ndarray, n: int, prior: float | None) -> tuple[float, np.ndarray]:
    """The risk of outputs, of which the first ``n`` are of positives and the others of unlabelled texts, and its
    derivative by each output (where the unlabelled part is negative, of what is minimised instead: minus that part).

    Without a prior, plain positive against unlabelled.
    """
    m = len(out) - n
    as_negative = np.logaddexp(0, out)
    as_positive = as_negative - out
    # derivative of the logistic loss: as positive sure - 1, as negative sure
    sure = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
    grad = np.empty(len(out), np.float32)
    if prior is None:
        grad[:n], grad[n:] = (sure[:n] - 1) / n, sure[n:] / m
        return float(as_positive[:n].mean() + as_negative[n:].mean()), grad
    trusted = prior * as_positive[:n].mean()
    rest = as_negative[n:].mean() - prior * as_negative[:n].mean()
    if rest >= 0:
        grad[:n], grad[n:] = -prior / n, sure[n:] / m
    else:  # the negative part has been fitted below zero: only push it back
        grad[:n], grad[n:] = prior * sure[:n] / n, -sure[n:] / m
    return float(trusted + max(0.0, rest)), grad


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, seed: int):
    """Weights after ``steps`` of Adam; without a prior, plain positive against unlabelled."""
    draw = np.random.default_rng(seed)
    width = 32
    weights = [draw.normal(0, positive.shape[1] ** -0.5, (positive.shape[1], width)), np.zeros(width),
               draw.normal(0, width**-0.5, width), np.zeros(1)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        p = positive[draw.integers(0, len(positive), 512)]
        u = unlabelled[draw.integers(0, len(unlabelled), 512)]
        z = np.concatenate([p, u])
        # strips this small are multiplied by one thread each, so that busy machines do not wait for each other
        strips = z.reshape(16, 64, -1)
        hidden, out = _forward(weights, strips)
        hidden, out = hidden.reshape(len(z), -1), out.ravel()
        grad = risk_gradient(out, 512, prior)[1]
        back = np.outer(grad, weights[2]) * (1 - hidden**2)
        grads = [(strips.transpose(0, 2, 1) @ back.reshape(16, 64, -1)).sum(0), back.sum(0), hidden.T @ grad, np.array([grad.sum()])]
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(grads):
            g = g + 1e-4 * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray) -> float:
    """The smallest ratio, over score thresholds, of the unlabelled to the positive share above the threshold, with
    a margin for the number of scores that shares are estimated from."""
    thresholds = np.unique(np.quantile(positive_scores, np.linspace(0, 0.9, 91)))
    p = np.array([(positive_scores >= t).mean() for t in thresholds])
    u = np.array([(unlabelled_scores >= t).mean() for t in thresholds])
    margin = np.sqrt(np.log(10) / 2) * (len(positive_scores) ** -0.5 + len(unlabelled_scores) ** -0.5)
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and the share of positives there: prior times the positives' density over the unlabelled density, in
    bins of equal unlabelled counts, made monotone by pooling neighbours."""
    bins = int(np.clip(len(unlabelled) // 40, 2, 60))
    edges = np.unique(np.quantile(unlabelled, np.linspace(0, 1, bins + 1))[1:-1])
    u = np.bincount(np.searchsorted(edges, unlabelled), minlength=len(edges) + 1) / len(unlabelled)
    p = np.bincount(np.searchsorted(edges, positive), minlength=len(edges) + 1) / len(positive)
    middle = np.array([np.median(b) if len(b) else np.nan for b in np.split(
        np.sort(unlabelled), np.searchsorted(np.sort(unlabelled), edges, "right"))])
    there = ~np.isnan(middle)
    pools: list[list[float]] = []
    for mass_p, mass_u, at in zip(p[there], u[there], middle[there]):
        pools.append([prior * mass_p, mass_u, [at]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    to = np.concatenate([np.full(len(at), min(1.0, a / b)) for a, b, at in pools])
    at = middle[there]
    # equal outputs of a pool stay in order: a slight slope tells them apart
    return at, np.clip(0.998 * to + 0.002 * np.linspace(0, 1, len(to)), 0, 1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 800, seed: int = 7) -> Model | None:
    """A model from features of positives and of unlabelled texts; None where either has none. A third of both is
    kept from training, for the prior and the calibration."""
    if not len(positive) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p = np.clip((positive - mean) / scale, -8, 8).astype(np.float32)
    u = np.clip((unlabelled - mean) / scale, -8, 8).astype(np.float32)
    draw = np.random.default_rng(seed)
    p, u = p[draw.permutation(len(p))], u[draw.permutation(len(u))]
    most_p, most_u = -(-len(p) * 2 // 3), -(-len(u) * 2 // 3)
    rest_p, rest_u = (p[most_p:], u[most_u:]) if len(p) > 2 and len(u) > 2 else (p, u)
    first = _train(p[:most_p], u[:most_u], None, steps, seed)
    prior = estimate_prior(_forward(first, rest_p)[1], _forward(first, rest_u)[1])
    weights = _train(p[:most_p], u[:most_u], prior, steps, seed)
    at, to = calibrate(_forward(weights, rest_p)[1], _forward(weights, rest_u)[1], prior)
    return Model(mean, scale, weights, prior, at, to)


def _features_of(texts: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of one text of each id, the smallest where an id has several."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "").astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])

    found = texts.select("doc_id", "text").mapInArrow(extract, f"doc_id {kind}, x binary")
    return found.groupBy("doc_id").agg(F.min("x").alias("x"))


def _matrix(rows) -> np.ndarray:
    flat = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32)
    return flat.reshape(-1, N_FEATURES).astype(np.float64)


def gathered(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held_out: int = 0, max_positive: int = 10_000, max_unlabelled: int = 20_000,
) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of trusted positives and of unlabelled documents, one row per id: what the driver holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    open_fold = fold("doc_id", folds) != held_out
    trusted = sample_ids(marked.where(open_fold & (F.col("label") == 1)), max_positive, 1).select("doc_id")
    plain = sample_ids(texts.where(open_fold).select("doc_id"), max_unlabelled, 2)
    # the sample's bound is a parameter, so it may be sent to every task instead of shuffling all texts
    rows = [_features_of(texts.join(F.broadcast(ids), "doc_id")).orderBy("doc_id").collect() for ids in (trusted, plain)]
    return _matrix(rows[0]), _matrix(rows[1])


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """Fits on at most ``max_positive`` trusted positives and ``max_unlabelled`` documents, both taken by hash of their
    ids from outside the held-out fold (see ``gathered``). The bounds are what the driver gathers, 0.5 kB of statistics
    a document; rows that repeat an id count once."""
    ship_package(docs.sparkSession)
    return fit(*gathered(docs, labels, **bounds))


def scored(text: Column, model: Model | None) -> Column:
    """How likely a whole text is a positive, as a column; nothing but the text goes through Python."""

    def find(texts: pa.Array) -> pa.Array:
        found = np.full(len(texts), 0.5)
        if model is not None and len(texts):
            # float32, as the training features are
            x = np.stack([features(t.as_py() or "").astype(np.float32) for t in texts])
            found = model.score(x.astype(np.float64))
        return pa.array(found, pa.float64())

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "double")(text)


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """All columns of the documents and ``score`` (see ``scored``), which replaces one of that name."""
    ship_package(docs.sparkSession)
    return docs.withColumn("score", scored(F.col(text_col), model))
