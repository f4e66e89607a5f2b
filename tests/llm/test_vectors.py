import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import with_clashes
from fleetlens.llm import graph_search, range_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def unusual(first):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0] * 8, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0]]
    return [(first + n, v, 1) for n, v in enumerate(bad)]


def clustered(n, seed=3, dim=8):
    """Clusters within which cosines lie around the threshold, exact copies, and labels that are null."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        center = np.random.default_rng(i % 17).normal(size=dim)
        v = center + draw.normal(size=dim) * 0.25 * (i % 5)
        if i % 10 == 9:
            v = center
        rows.append((i, [float(x) for x in np.float32(v)], None if i % 23 == 0 else int(i % 3)))
    return rows


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine=0.93):
    links = {n: set() for n in range(len(rows))}
    for a, (_, x, p) in enumerate(rows):
        for b, (_, y, q) in enumerate(rows[:a]):
            if p is not None and p == q and usable(x) and usable(y) and len(x) == len(y):
                x_, y_ = np.float64(x), np.float64(y)
                if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= cosine:
                    links[a].add(b), links[b].add(a)
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[n]), min(rows[s][0] for s in seen)))
    return sorted(out)


@pytest.mark.parametrize("block_rows, pivots", [(2048, 16), (7, 60), (7, 5), (2048, 0), (7, 1000)])
def test_range_join_finds_all_links(spark, block_rows, pivots):
    # ids that are repeated with the same vector and label, with another vector, and with another label
    rows = clustered(260) + unusual(900) + [(7, clustered(8)[7][1], 1), (8, clustered(12)[11][1], 2), (9, clustered(20)[19][1], 2)]
    vectors = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = range_join.near_vectors(vectors, block_rows=block_rows, pivots=pivots).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_pairs_are_compared_once_in_one_cell():
    """Every pair within the radius meets in exactly one cell, at home there on one side at least."""
    draw = np.random.default_rng(9)
    x = range_join._unit(draw.normal(size=(40, 6))[draw.integers(0, 40, 500)] + 0.15 * draw.normal(size=(500, 6)))
    radius = float(np.sqrt(2 - 2 * 0.93))
    pivots = range_join.farthest_first(x[:200], 24)
    home, cells = range_join.cells_of(x, pivots, radius)
    assert cells[np.arange(len(x)), home].all() and not (cells & (np.arange(24)[None, :] > home[:, None])).any()
    near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(near) > 500
    for a, b in near:
        met = [c for c in np.flatnonzero(cells[a] & cells[b]) if c in (home[a], home[b])]
        assert min(home[a], home[b]) in met
        assert sum(c == home[a] or c == home[b] for c in met) == 1 or home[a] != home[b]


def test_pivots_prune_where_vectors_cluster(spark):
    """Clusters of their own: a vector reaches less than a quarter of the cells. Vectors at like distances: few pivots."""
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(200, 64))
    near = centers[draw.integers(0, 200, 6000)] + 0.1 * draw.normal(size=(6000, 64))
    radius = float(np.sqrt(2 - 2 * 0.93))
    rows = [(n, v, 0) for n, v in enumerate(np.float32(near).tolist())]
    classes = spark.createDataFrame(rows, "id long, vector array<float>, label int").withColumn("copies", F.lit(1).cast("long"))
    pivots = range_join._sampled_pivots(classes, radius, 512, 256, 4096)
    cells = range_join.replicated(classes, pivots, radius)
    n = len(pivots[0, 64])
    assert n >= 64 and cells.count() / 6000 < n / 4
    even = range_join.choose_pivots(range_join._unit(draw.normal(size=(2000, 64))), 50_000, radius, 256)
    assert len(even) <= 16


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert range_join.near_vectors(none).collect() == []
    assert graph_search.nearest(none, F.lit(True)).collect() == []


def brute_nearest(rows, query, k=20):
    ids = np.array([i for i, v, _ in rows if usable(v) and len(v) == 8])
    vectors = np.array([v for _, v, _ in rows if usable(v) and len(v) == 8], np.float64)
    own = vectors[ids == query][0]
    scores = vectors @ own
    order = [n for n in np.lexsort((ids, -scores)) if ids[n] != query][:k]
    return [(int(ids[n]), float(scores[n])) for n in order]


def test_nearest_with_ties_and_unusual_vectors(spark):
    rows = clustered(150) + [(1000 + n, clustered(10)[9][1], 0) for n in range(60)] + unusual(2000)
    vectors = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in graph_search.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    asked = [i for i, v, _ in rows if i % 20 == 0 and usable(v) and len(v) == 8]
    assert sorted(got) == asked
    for q in asked:
        want = brute_nearest(rows, q)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)


@pytest.mark.parametrize("query_rows", [65_536, 3])
def test_every_length_takes_part(spark, query_rows):
    """Queries find the nearest of their own length; a length without queries, or a query alone in its length, does no harm."""
    draw = np.random.default_rng(6)
    rows = [(n, draw.normal(size=(3, 5, 2)[n % 3]).tolist(), 0) for n in range(240)] + [(901, [1.0], 0), (920, [2.0] * 9, 0)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = {}
    found = graph_search.nearest(vectors, (F.col("vec_id") % 20 == 0) & (F.size("embedding") != 2), shard_rows=30, query_rows=query_rows)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    held = dict((i, np.float32(v).astype(float)) for i, v, _ in rows)
    asked = [i for i in held if i % 20 == 0 and len(held[i]) in (3, 5)]
    assert sorted(got) == asked and len(asked) == 8
    for q in asked:
        same = [i for i in held if len(held[i]) == len(held[q]) and i != q]
        assert got[q] == sorted(same, key=lambda i: (-(held[i] @ held[q]), i))[:20]


def test_each_shard_is_a_task(spark):
    """No task holds two shards: tasks are numbered, not hashed."""
    draw = np.random.default_rng(8)
    vectors = spark.createDataFrame([(n, draw.normal(size=4).tolist(), 0) for n in range(400)], SCHEMA)
    seen = []
    plain = graph_search._search_shard

    def spy(k, beam, block):
        search = plain(k, beam, block)

        def count(batches):
            shards = set()

            def watched():
                for batch in batches:
                    shards.update(batch.column("shard").to_pylist())
                    yield batch

            yield from search(watched())
            assert len(shards) <= 1, shards

        seen.append(1)
        return count

    graph_search._search_shard = spy
    try:
        assert graph_search.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=50).count() == 400
    finally:
        graph_search._search_shard = plain
    assert seen


def test_queries_stream_past_the_graph_of_their_shard():
    draw = np.random.default_rng(4)
    sent = []

    def rows(shard, kind, first, n):
        vectors = pa.array(draw.normal(size=(n, 4)).tolist(), pa.list_(pa.float64()))
        columns = [pa.array([shard] * n), pa.array([kind] * n, pa.int32()), pa.array(range(first, first + n)), vectors]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "id", "vector"])

    def batches():
        # the points of shard 0 in two batches, its queries in many; one batch holds its last queries and shards 1 and 2
        queries = [rows(0, 1, 100 + 10 * n, 10) for n in range(20)]
        mixed = pa.concat_batches([rows(0, 1, 300, 5), rows(1, 0, 40, 20), rows(1, 1, 100, 3), rows(2, 1, 100, 3)])
        for batch in [rows(0, 0, 0, 30), rows(0, 0, 30, 10), *queries, mixed]:
            sent.append(batch)
            yield batch

    answers = graph_search._search_shard(3, 48, 512)(batches())
    first = next(answers)
    # answered with one batch of queries read, not all of them
    assert len(sent) == 3 and set(first.column("query_id").to_pylist()) == set(range(100, 110))
    got = {}
    for batch in [first, *answers]:
        for r in batch.to_pylist():
            got.setdefault((r["point"] >= 40, r["query_id"]), []).append((r["point"], r["score"]))
    every = pa.Table.from_batches(sent).to_pylist()
    for shard, asked in ((0, 205), (1, 3)):
        points = [r for r in every if r["shard"] == shard and r["kind"] == 0]
        queries = [r for r in every if r["shard"] == shard and r["kind"] == 1]
        assert len(queries) == asked
        for q in queries:
            want = sorted(((-np.dot(q["vector"], p["vector"]), p["id"]) for p in points))[:4]
            assert [i for i, _ in got.pop((shard == 1, q["id"]))] == [i for _, i in want]
    assert not got  # a shard without points answers nothing


def test_few_candidates(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [2.0, 1.0], 1), (2, [0.0, -1.0], None)], SCHEMA)
    rows = graph_search.nearest(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["score"]) for r in rows] == [(1, 1, 2.0), (2, 2, 0.0)]
    alone = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert graph_search.nearest(alone, F.lit(True)).collect() == []


def test_recall_in_a_large_shard():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(3000, 32)), draw.normal(size=32) + 0.05 * draw.normal(size=(500, 32))])
    graph = graph_search.Graph(graph_search.same_length(points))
    queries = points[::25]
    found, _ = graph.search(np.hstack([queries, np.zeros((len(queries), 1))]), 96)
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:96]) & set(b)) / 20 for a, b in zip(found, exact)]) >= 0.9
