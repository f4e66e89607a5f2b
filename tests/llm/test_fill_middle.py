import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import prose, with_clashes
from fleetlens.llm import fill_middle as fim

UNIT = {"lines": r"[^\n]*\n|[^\n]+", "sentences": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "characters": r"(?s:.)"}


def brute(doc_id, text, unit="lines", rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * n : 8 * n + 8], 16) for n in range(4))
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus(tricky):
    rows = [(d, t) for d, t, _ in tricky]
    rows += [(None, "no id\nat all"), (20, "\n"), (21, "\n\n\n"), (22, "no end"), (23, "ends\n"), (24, "a\r\nb\r\n"), (25, "has <S> in it\nx")]
    rows += [(26, "<P>\n<M>"), (27, "<\nP>\n<S\n>"), (28, "日本。\n🙂🙂\nÀ\n"), (29, "x y\x0bz\x85w\n")]
    draw = random.Random(8)
    rows += [(100 + n, "".join(draw.choice("ab <P\n.") for _ in range(draw.randrange(40)))) for n in range(200)]
    rows += [(400, "\n".join(prose(n, 9) for n in range(4000)))]
    return rows


@pytest.mark.parametrize("unit,rate,spm", [("lines", 100, 50), ("sentences", 60, 20), ("characters", 100, 100)])
def test_against_brute_force(spark, tricky, unit, rate, spm):
    rows = corpus(tricky)
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(
        {"n": F.lit("mine"), "doc": F.lit(1), "fim": F.lit(2)})
    made = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    assert set(docs.columns) | {"form", "prefix_chars", "middle_chars", "output"} == set(made.columns)
    made = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made]
    want = [(d, *brute(d, t, unit, rate, spm)) for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["back"] == (r["text"] or "") for r in made)
    assert {r["form"] for r in made} == {"plain", "spm"} | ({"psm"} if spm < 100 else set())


def test_no_rows(no_docs):
    assert fim.fill_in_middle(no_docs).collect() == []


def test_texts_of_several_slices(monkeypatch, spark, tricky):
    """Slices bound what is held at once and change nothing."""
    texts = [t or "" for _, t in corpus(tricky)]
    first, second = np.arange(len(texts)) * 7919, np.arange(len(texts)) * 104729
    whole = fim.cut_places(texts, first, second, "lines")
    monkeypatch.setattr(fim, "CODE_POINTS", 500)
    parts = [fim.cut_places(texts[a:b], first[a:b], second[a:b], "lines") for a, b in fim._slices(texts)]
    assert len(parts) > 10
    for name in ("units", "prefix", "middle"):
        assert np.array_equal(np.concatenate([getattr(p, name) for p in parts]), getattr(whole, name))


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_wavelet_ranks(size):
    values = np.random.default_rng(size).integers(0, 7, size).astype(np.uint8)
    matrix = fim.WaveletMatrix(values)
    places = np.arange(size + 1)
    for value in range(8):
        assert np.array_equal(matrix.rank(value, places), np.concatenate([[0], np.cumsum(values == value)]))
    total = int((values == 0).sum())
    zero, end = np.zeros(total + 1, np.int64), np.full(total + 1, size)
    found = matrix.after((0,), np.arange(total + 1), zero, end)
    assert found.tolist() == [0, *(np.flatnonzero(values == 0) + 1)]
