import re
from collections import defaultdict

import pytest

from fleetlens.llm import mixing


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def water_fill(sizes, weights, share, most):
    """Shares by weight; what is above a cap is shared again among the others until none is above."""
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [k for k in sizes if k not in capped]
        w = sum(weights[k] for k in open_)
        over = {k: most * sizes[k] for k in open_ if rest * weights[k] / w > most * sizes[k] + 1e-9}
        if not over:
            return capped | {k: rest * weights[k] / w for k in open_}
        capped |= over


def targets_of(docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    return sizes, water_fill(sizes, weights, 1.5, 2.0)


@pytest.mark.parametrize("block_words", [7, 1024])
def test_tricky_documents(tricky_docs, tricky, block_words):
    rows = mixing.taken(mixing.mix(tricky_docs, block_words=block_words)).collect()
    sizes, targets = targets_of(tricky)
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((i, size(t)) for i, t, _ in tricky)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) < 1


def test_pieces_tell_which_words(spark, tricky_docs):
    mixed = mixing.mix(tricky_docs, block_words=50)
    pieces = mixed.pieces.collect()
    assert len({(p["slot"]) for p in pieces}) == len({(p["k"], p["rank"]) for p in pieces})
    per_slot = defaultdict(int)
    for p in pieces:
        per_slot[p["slot"]] += p["words"]
    # blocks are equal within a source and differ between sources by the rounding of its slots
    sizes = sorted(per_slot.values())
    assert 45 <= sizes[len(sizes) // 20] and sizes[-len(sizes) // 20] <= 55
    assert sorted(map(tuple, pieces), key=repr) == sorted(map(tuple, mixing.mix(tricky_docs, block_words=50).pieces.collect()), key=repr)


def test_a_schedule_keeps_to_its_weights(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 400, s) for i, s in enumerate(["a"] * 30 + ["b"] * 30 + ["c"] * 30)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block_words=100)
    slots = sorted({(p["slot"], p["source"]) for p in mixed.pieces.collect()})
    share = {r["k"][1:]: r["target"] / 54_000 for r in mixed.sources.collect()}
    for n in (50, 150, 400):
        for s in "abc":
            assert abs(sum(x == s for _, x in slots[:n]) / n - share[s]) < 0.05


def test_no_documents(no_docs, spark):
    assert mixing.taken(mixing.mix(no_docs)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.taken(mixing.mix(blank)).collect()] == [(0, 0, 0.0)] * 2
