import hashlib
import math

import numpy as np
import pytest

from conftest import with_clashes
from fleetlens.llm.sharded_lloyd import lloyd

DIMS = 6


def brute(rows, k, rounds, scale=1024):
    """Lloyd's rounds with Python's integers, row by row."""
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == n) for n in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for i, c, d in out), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    points = [(n, (draw.normal(0, 0.4, DIMS) + 2 * (n % 3)).tolist()) for n in range(220)]
    points += [(500 + n, points[7][1]) for n in range(60)]  # copies
    points += [(7, points[7][1]), (7, points[9][1]), (None, points[11][1]), (None, points[12][1])]
    points += [(300, None), (301, []), (302, [1.0] * (DIMS - 1)), (303, [1.0] * (DIMS + 1)), (304, [float("nan")] * DIMS)]
    points += [(305, [float("inf")] + [0.0] * (DIMS - 1)), (306, [None] + [0.0] * (DIMS - 1)), (307, [0.0] * DIMS)]
    points += [(308, [-1e9] + [0.0] * (DIMS - 1)), (309, [-3.0001] * DIMS)]
    return points, with_clashes(spark.createDataFrame(points, "vec_id long, embedding array<double>")).repartition(3).cache()


@pytest.mark.parametrize("k,block_dims,piece_rows", [(8, 3, 16), (5, 4, 1000), (3, 1, 50)])
def test_lloyd_against_brute_force(vectors, k, block_dims, piece_rows):
    points, df = vectors
    got = lloyd(df, k=k, rounds=4, dims=DIMS, block_dims=block_dims, piece_rows=piece_rows)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(points, k, 4)


def test_few_vectors_and_none(spark, vectors):
    points, _ = vectors
    few = spark.createDataFrame(points[:3], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, lloyd(few, rounds=2, dims=DIMS).collect()), key=repr) == brute(points[:3], 8, 2)
    assert lloyd(few, dims=7).collect() == [] and lloyd(few.limit(0), dims=DIMS).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lloyd_")]


def test_blocks_are_not_shuffled_in_a_round(spark, vectors):
    """The stored blocks meet the assignments of a round where they lie: partial distances and assignments alone move."""
    from fleetlens.llm import sharded_lloyd as s

    df = vectors[1].selectExpr("vec_id as id", "embedding as vector")
    kept = df.where(s.takes_part(df["vector"], DIMS, 1024))
    blocks, name = s._bucketed(s._pieces(kept, 3, 1024, 16))
    first = s.first_centroids(kept, 4, "3", 1024)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = blocks.join(s._assigned(blocks, first, 3).select("piece", "clusters"), "piece")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    own, assigned = plan[plan.index("SortMergeJoin"):].split("FlatMapGroupsInArrow")
    assert own.count("Exchange") == 1 and "Bucketed: true" in own  # that of the assignments, above their groups
    assert assigned.count("Exchange") == 1
