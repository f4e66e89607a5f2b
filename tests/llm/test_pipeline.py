import ast
import inspect
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import prose
from fleetlens.llm import common, mixing, quality, toxicity
from fleetlens.llm.queries import QUERIES
from test_mixing import size
from test_near_dup import brute, edited
from test_packing import check_places, expected


def test_stages_and_entry():
    import __spark_entry__

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    # the pipeline hides no failed import
    assert not any(isinstance(n, ast.Try) for n in ast.walk(ast.parse(inspect.getsource(corpus_pipeline))))


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{n}"
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if n < 4:
            assert docs.columns == columns, name
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20), (None, 5), (30, 31), (31, 30), (30, 31)]
    links += [(100 + n, 101 + n) for n in range(40)] + [(200, 201 + n) for n in range(50)] + [(250, 300)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 50} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 30: 30, 31: 30}
    assert all(v == 100 for k, v in got.items() if 100 <= k <= 140) and all(v == 200 for k, v in got.items() if k >= 200)
    assert len(got) == 11 + 41 + 52
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def corpus():
    """(doc_id, text, source) with null ids, repeated rows, an id with two texts, near copies and blank texts."""
    one, two, three, four = (prose(n, 120) for n in (31, 32, 33, 34))
    rows = [
        (1, one, "a"), (2, one, "b"), (2, two, "a"), (3, edited(two, 1, 1), "b"), (3, four, "a"), (4, edited(one, 2, 2), "a"),
        (5, None, "a"), (5, None, "a"), (6, " ", None), (6, "", "b"), (9, "few words", None), (8, "FEW words", None),
    ]
    rows += [(None, one, "a"), (None, one, "a"), (None, None, "b"), (None, "only here", None)]
    rows += [(7, three, "b")] * 5 + [(10, edited(three, 3, 2), "a")] * 3
    return rows


def table_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    return docs.withColumns({c: F.lit("x") for c in ("row", "doc", "times", "round", "_round", "kept", "component_id")})


def kept_by_brute_force(rows, percent):
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    groups = brute([(n, text) for n, (_, text, _) in enumerate(named)], percent)
    return Counter([named[n][:2] for n, _, low in groups if n == low] + [r[:2] for r in rows if r[0] is None])


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    docs = table_of(spark, corpus())
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == kept_by_brute_force(corpus(), 80)
    # the fixture tells 0.8 from 0.85
    assert kept_by_brute_force(corpus(), 80) != kept_by_brute_force(corpus(), 85)


def test_mixing_stage_repeats_rows_as_often_as_they_are_taken(spark):
    docs = table_of(spark, corpus())
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    copies = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = Counter()
    for r in mixing.taken(mixing.mix(docs)).where("size > 0").collect():
        want[r["doc_id"], r["size"]] += int(r["taken"] / r["size"] + 0.5)
    by_size = Counter()
    for (i, text), n in copies.items():
        by_size[i, size(text)] += n
    assert by_size == +want and any(i is None for i, _ in copies)
    there = Counter(r[:2] for r in corpus())
    assert all(n <= 2 * there[key] for key, n in copies.items())


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """The corpus with junk and insults, columns named like results, and labels for some of it."""
    rows = [(i, t, s) for i, t, s in corpus()]
    for n in range(900):
        text = prose(500 + n, 30)
        if n % 3 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif n % 5 == 0:
            text += ". you blorgh snerkle."
        rows.append((100 + n, text, "ab"[n % 2]))
    folder = str(tmp_path_factory.mktemp("sf"))
    labels = [(100 + n, int(n % 3 != 0), int(n % 3 != 0 and n % 5 == 0)) for n in range(900)] + [(None, 1, 1), (1, 1, 0), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    docs = table_of(spark, rows).withColumns({"score": F.lit(7.0), "offending": F.lit("mine"), "label": F.lit(3), "x": F.lit("y")})
    return rows, docs.cache(), folder


def texts_of(df):
    rows = df.collect()
    assert all((r["score"], r["offending"]) == (7.0, "mine") for r in rows)
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_quality_stage_against_brute_force(spark, labelled):
    rows, docs, folder = labelled
    got = corpus_pipeline.quality_stage(spark, docs, folder)
    assert got.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def good(text):
        x = quality.features(text or "").astype(np.float32).astype(np.float64)
        return model.score(x[None, :])[0] >= 0.3

    kept = texts_of(got)
    assert kept == Counter(r for r in rows if good(r[1]))
    # with so few labels the model is rough, but junk goes rather than the rest
    junk = sum("###" in (t or "") for _, t, _ in kept) / 300
    rest = sum(i is not None and i >= 100 and "###" not in t for i, t, _ in kept) / 600
    assert rest > 0.6 and junk < rest - 0.3


def test_toxicity_stage_against_brute_force(spark, labelled):
    rows, docs, folder = labelled
    got = corpus_pipeline.toxicity_stage(spark, docs, folder)
    assert got.columns == docs.columns
    scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    kept = texts_of(got)
    assert kept == Counter(r for r in rows if scorer(r[1] or "")[1] < 0.3)
    assert not any(t and "blorgh" in t for _, t, _ in kept) and any(t is None for _, t, _ in kept)


def test_packing_stage_against_brute_force(spark, labelled):
    rows, docs, folder = labelled
    packed = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert got == expected([r[:2] for r in rows])
    check_places(packed)


def test_recall_of_the_near_duplicate_stage_by_similarity(spark):
    """Copies that are less alike than 0.8 are no links; all that are, are found."""
    rows, want = [], {}
    for n in range(60):
        text = prose(900 + n, 400)
        copy = edited(text, n, 1 + n % 12)
        rows += [(2 * n, text, "a"), (2 * n + 1, copy, "a")]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, table_of(spark, rows), "").collect()}
    alike = {i: low for i, _, low in brute([r[:2] for r in rows], 80)}
    assert got == {i for i, low in alike.items() if i == low}
    assert 10 < sum(i != low for i, low in alike.items()) < 55  # both sides of the threshold are there


def test_stages_on_empty_tables(spark, no_docs):
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.mixing_stage, corpus_pipeline.packing_stage):
        assert stage(spark, no_docs, "").collect() == []
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage):
        assert stage(spark, no_docs, "/root/testdata/sf0.001").collect() == []
