import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import prose, with_clashes
from fleetlens.llm import quality, toxicity
from fleetlens.llm.sampling import fold

INSULTS = ("blorgh", "snerkle", "vextrum")


@pytest.fixture(scope="module")
def corpus(spark):
    """Junk and prose; some prose with one sentence of insults. Four fifths are labelled."""
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        good, toxic = i % 4 != 0, i % 9 == 0
        sentences = [prose(10_000 + 20 * i + n, draw.randint(4, 12)) for n in range(draw.randint(2, 8))]
        if toxic:
            sentences[draw.randrange(len(sentences))] += f" {draw.choice(INSULTS)} {draw.choice(INSULTS)}"
        text = ". ".join(sentences) + "."
        if not good:
            text = " ".join(w + "###" for w in text.split())
        docs.append((i, text))
        if draw.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    return (
        with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        dict(docs),
    )


def test_folds_are_those_of_the_ids_text(spark):
    rows = spark.range(200).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_quality_on_held_out_documents(corpus, tricky_docs):
    docs, labels, _ = corpus
    model = quality.train(docs, labels)
    assert 0.6 < model.prior < 0.9
    scored = quality.score(docs, model).where(fold("doc_id", 5) == 0).collect()
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in scored]
    assert np.mean(right) > 0.9
    rows = quality.score(tricky_docs, model)
    assert set(tricky_docs.columns) == set(rows.columns)
    assert all(0 <= r["score"] <= 1 for r in rows.collect()) and rows.count() == tricky_docs.count()


def test_toxicity_on_held_out_documents(corpus, tricky_docs):
    docs, labels, texts = corpus
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).where(fold("doc_id", 4) == 2).collect()
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 9 == 0) for r in scored]
    assert np.mean(right) > 0.9
    located = [
        any(w in texts[r["doc_id"]][s["begin"] : s["end"]] for w in INSULTS)
        for r in scored for s in r["offending"] if r["doc_id"] % 9 == 0
    ]
    assert located and np.mean(located) > 0.9
    rows = toxicity.score(tricky_docs, model)
    assert all(0 <= r["score"] <= 1 for r in rows.collect()) and rows.count() == tricky_docs.count()


def test_labels_of_the_held_out_folds_do_not_matter(corpus):
    docs, labels, _ = corpus
    turned = labels.withColumns({
        "quality": F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")),
        "toxic": F.when(fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")),
    })
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights))
    c, d = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(c.weights, d.weights) and c.bias == d.bias


def test_without_labels(spark, tricky_docs, no_docs):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.train(tricky_docs, labels) is None and toxicity.train(tricky_docs, labels) is None
    assert {r["score"] for r in quality.score(tricky_docs, None).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(tricky_docs, None).collect()} == {0.0}
    assert quality.score(no_docs, None).collect() == [] and toxicity.score(no_docs, None).collect() == []


def test_the_prior_is_not_overstated():
    draw = np.random.default_rng(1)
    positive = draw.normal(3, 1, 4000)
    unlabelled = np.concatenate([draw.normal(3, 1, 2800), draw.normal(-3, 1, 1200)])
    assert quality.estimate_prior(positive, unlabelled) == pytest.approx(0.7, abs=0.04)


def test_an_id_with_many_rows_counts_once(spark, corpus):
    """What is gathered keeps to its bounds however often an id is repeated, and whatever its texts are."""
    docs, labels, texts = corpus
    copies = spark.range(1000).select(F.lit(3).alias("doc_id"), F.lit(texts[3]).alias("text"))
    others = spark.range(50).select(F.lit(4).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    many = docs.select("doc_id", "text").unionByName(copies).unionByName(others)
    once = docs.select("doc_id", "text").where("doc_id <> 4").unionByName(others.where("text = 'text 7'"))
    p, u = quality.gathered(many, labels)
    q, v = quality.gathered(once, labels)
    assert len(p) == len(q) and len(u) == len(v) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in texts)
    for bound in (1, 7):
        p, u = quality.gathered(many, labels, max_positive=bound, max_unlabelled=bound)
        assert len(p) == len(u) == bound
        bags, toxic, _ = toxicity.gathered(many, labels, max_labelled=bound)
        assert len(bags) == len(toxic) == bound
    twice = labels.unionByName(labels)
    assert len(toxicity.gathered(many, twice)[0]) == len(toxicity.gathered(docs, labels)[0])
    bags = toxicity.gathered(docs, labels, max_bytes=1200)[0]
    assert 0 < sum(map(len, bags)) <= 1200


def test_long_labelled_texts_are_learned_from(spark):
    """Whole texts of any length: only the long ones hold the word that tells."""
    filler = " ".join(prose(n, 12) + "." for n in range(1200))
    rows = [(i, f"{filler} blorgh snerkle. {filler}" if i % 2 else filler) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows[1][1]) > 100_000
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    bags, toxic, _ = toxicity.gathered(docs, labels)
    assert len(toxic) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    # alike sentences are held once: a bag grows with the evidence
    assert max(map(len, bags)) < 200
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((scores[i] >= 0.3) == (i % 2 == 1) for i, _ in rows)


def test_noisy_or_against_a_plain_loop():
    draw = random.Random(2)
    documents = [[[draw.randrange(6) for _ in range(draw.randrange(4))] for _ in range(draw.randint(1, 5))] for _ in range(30)]
    documents[3] = documents[3] * 3
    toxic = np.array([draw.random() < 0.4 for _ in documents])
    held = toxicity.Bags.of([
        np.array([x for s in d for x in (-1, *sorted(set(s)))], np.int32).tobytes() for d in documents])

    def loss(weights, bias):
        total = 0.0
        for d, y in zip(documents, toxic):
            clean = 1.0
            for s in d:
                clean *= 1 - 1 / (1 + np.exp(-(bias + sum(weights[f] for f in set(s)))))
            total -= np.log(1 - clean) if y else np.log(clean)
        return total / len(documents)

    weights, bias = np.array([draw.gauss(0, 1) for _ in range(6)]), -0.7
    assert held.used.tolist() == list(range(6))
    value, grad, grad_bias = toxicity.gradient(held, toxic, weights, bias)
    assert value == pytest.approx(loss(weights, bias), rel=1e-9)
    step = 1e-6
    for f in range(6):
        up, down = weights.copy(), weights.copy()
        up[f], down[f] = up[f] + step, down[f] - step
        assert grad[f] == pytest.approx((loss(up, bias) - loss(down, bias)) / (2 * step), abs=1e-6)
    assert grad_bias == pytest.approx((loss(weights, bias + step) - loss(weights, bias - step)) / (2 * step), abs=1e-6)
    # sentences of one kind, counted, are the same sentences
    kinds = toxicity.Bags.of([
        np.array([x for s in {tuple(sorted(set(s))) for s in d} for x in (-sum(set(s) == set(t) for t in d), *s)], np.int32).tobytes()
        for d in documents])
    again = toxicity.gradient(kinds, toxic, weights, bias)
    assert again[0] == pytest.approx(value) and np.allclose(again[1], grad) and again[2] == pytest.approx(grad_bias)


@pytest.mark.parametrize("prior,shift", [(None, 0), (0.3, 0), (0.9, -3)])
def test_positive_unlabelled_risk_against_a_plain_loop(prior, shift):
    draw = np.random.default_rng(5)
    out, n = draw.normal(shift, 1, 40), 15
    if shift:
        out[:n] += 5  # the unlabelled part is below zero

    def parts(out):
        positive = [np.log1p(np.exp(-z)) for z in out[:n]]
        negative = [np.log1p(np.exp(z)) for z in out]
        if prior is None:
            return sum(positive) / n, sum(negative[n:]) / (len(out) - n)
        return prior * sum(positive) / n, sum(negative[n:]) / (len(out) - n) - prior * sum(negative[:n]) / n

    trusted, rest = parts(out)
    risk, grad = quality.risk_gradient(out, n, prior)
    assert risk == pytest.approx(trusted + (rest if prior is None else max(0.0, rest)))
    assert (rest < 0) == bool(shift)
    for k in range(len(out)):
        up, down = out.copy(), out.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        target = (lambda o: -parts(o)[1]) if rest < 0 else (lambda o: sum(parts(o)))
        assert grad[k] == pytest.approx((target(up) - target(down)) / 2e-6, abs=1e-5)


def test_edges_of_scores(spark, corpus):
    """Columns named like results stay the caller's where the column form is used, and are replaced by ``score``."""
    docs, labels, _ = corpus
    model, other = quality.train(docs, labels), toxicity.train(docs, labels)
    rows = docs.withColumns({"score": F.lit(7.0), "offending": F.lit("mine")})
    kept = rows.where((quality.scored(F.col("text"), model) >= 0.3) & (toxicity.scored(F.col("text"), other)["score"] < 0.3))
    assert {(r["score"], r["offending"]) for r in kept.collect()} == {(7.0, "mine")} and kept.columns == rows.columns
    replaced = toxicity.score(quality.score(rows, model), other)
    assert sorted(replaced.columns) == sorted(rows.columns)
