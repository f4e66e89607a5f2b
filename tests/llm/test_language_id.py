import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import with_clashes
from fleetlens.llm import language_id as lid
from fleetlens.llm.sampling import fold

SYLLABLES = {
    "xa": ["the", "ing", "er", "on", "th", "ed", "wh"], "xb": ["ein", "sch", "ung", "ich", "ä", "ß", "keit"],
    "xc": ["ción", "que", "os", "ñ", "ll", "ado", "es"], "xd": ["привет", "как", "ши", "ов", "ет", "да", "не"],
}


def sentence(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    rows = []
    for i in range(800):
        lang = ("xa", "xa", "xa", "xb", "xc", "xd")[i % 6]
        text = sentence(draw, lang, draw.randint(5, 60))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 5 else None))
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cache()


@pytest.fixture(scope="module")
def model(corpus):
    return lid.train(corpus)


def test_held_out_documents(corpus, model):
    assert sorted(set(model.languages)) == ["xa", "xb", "xc", "xd"] and len(model.languages) == 16
    made = lid.identify(corpus, model)
    assert set(made.columns) == set(corpus.columns) | {"nearest", "lang_score", "rejected", "language"}
    rows = made.where((fold("doc_id", 3) == 1) & F.col("lang").isNotNull()).collect()
    assert len(rows) > 150 and np.mean([r["nearest"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["lang_score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.05


def test_what_is_of_no_language_is_rejected(spark, model):
    """Far from every centroid: rejected; no letter at all: no language."""
    rows = [(1, "ζωή μου σας αγαπώ κόσμε " * 20), (2, "12 + 3!!"), (3, None), (4, ""), (5, "the ing whed thon eder " * 10)]
    made = {r["doc_id"]: r for r in lid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert made[1]["rejected"] and made[1]["language"] == "und" and made[1]["nearest"] in SYLLABLES
    assert all((made[n]["nearest"], made[n]["language"], made[n]["lang_score"]) == ("und", "und", 0.0) for n in (2, 3, 4))
    assert made[5]["language"] == "xa" and not made[5]["rejected"]


def test_labels_of_the_held_out_fold_do_not_matter(corpus, model):
    turned = corpus.withColumn("lang", F.when(fold("doc_id", 3) == 1, F.lit("zz")).otherwise(F.col("lang")))
    again = lid.train(turned)
    assert again.languages == model.languages and np.allclose(again.centroids, model.centroids, atol=1e-6)


def test_edges(spark, corpus, model, tricky_docs, no_docs):
    made = lid.identify(tricky_docs, model)
    assert made.count() == tricky_docs.count() and lid.identify(no_docs, model).collect() == []
    empty = lid.train(no_docs.withColumn("lang", F.lit("xa")))
    assert {(r["nearest"], r["lang_score"], r["rejected"]) for r in lid.identify(corpus, empty).collect()} == {("und", 0.0, True)}
    # one row a thousand times under one id is within the bound as well
    copies = spark.range(1000).select(F.lit(2).alias("doc_id"), F.lit("the ing").alias("text"), F.lit("xa").alias("lang"))
    assert lid._sample(copies.unionByName(corpus.select("doc_id", "text", "lang").dropna()), 90).count() <= 90


def test_sampled_evenly(corpus):
    labelled = corpus.select("doc_id", "text", "lang").dropna()
    sizes = {r["lang"]: r["count"] for r in lid._sample(labelled, 200).groupBy("lang").count().collect()}
    assert set(sizes) == set(SYLLABLES) and max(sizes.values()) <= 2.5 * min(sizes.values())


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 50])
def test_stretches_change_nothing(monkeypatch, stretch):
    draw = random.Random(stretch)
    texts = ["".join(draw.choice("ab É\n9ß日") for _ in range(draw.randrange(1, 120))) for _ in range(40)]
    whole = [lid.counts(t) for t in texts]
    monkeypatch.setattr(lid, "STRETCH", stretch)
    for a, b in zip(whole, map(lid.counts, texts)):
        assert (a is None and b is None) or np.array_equal(a, b)


def test_counts_against_plain_loop():
    text = "Ab, c1d  eF"
    runs, grams = " ab c d ef ", []
    for n in (1, 2, 3):
        for k in range(len(runs) - n + 1):
            if runs[k + n // 2] != " ":
                grams.append(runs[k : k + n])
    assert lid.counts(text).sum() == len(grams)
    assert (lid.counts(text) > 0).sum() == len(set(grams))
