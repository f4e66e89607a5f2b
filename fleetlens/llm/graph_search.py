"""Approximate nearest neighbours by largest inner product: one robust-pruned directed graph per shard.

Distinct vectors are dealt to shards by length and hash. A shard appends one component to each vector so that all have the same
length; the largest inner product is then the smallest distance. Points enter the graph in growing batches: greedy
search from the middle point proposes neighbours, and a neighbour is kept only if no kept one is closer to it by a
relaxed factor, so that edges point in many directions. A second pass runs over all points. Queries walk the graph of
every shard with a beam, in blocks, and what the shards find is ranked by the exact inner product in double precision.

All steps of a batch are array operations over the whole batch; nothing loops over single points.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; the candidates of a
query are the vectors of its own length; equal vectors are one point, whose smallest ids are given first; a query does not find its
own id; with fewer candidates than ``k`` all are given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import cut
from fleetlens.llm.vectors import matrix, usable
from fleetlens.session import ship_package


class Graph:
    """A directed graph over the rows of ``points``; -1 stands for no edge."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 48, relaxed: float = 1.05, seed: int = 5):
        # float32 for walking; exact products are taken outside
        self.points = points.astype(np.float32)
        self.norms = (self.points**2).sum(1)
        self.degree, self.beam, self.relaxed = degree, beam, relaxed
        n = len(points)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32) if n else order
        done = 1
        while done < n:  # each batch is no larger than what the graph already holds
            self._insert(order[done : done + min(done, 1024)])
            done += min(done, 1024)
        for at in range(0, n, 1024):
            self._insert(order[at : at + 1024])

    def _distances(self, queries: np.ndarray, lengths: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of points."""
        safe = np.maximum(found, 0)
        products = np.einsum("qd,qcd->qc", queries, self.points[safe], optimize=False)
        return np.where(found < 0, np.inf, lengths[:, None] + self.norms[safe] - 2 * products)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` points (and squared distances) that a greedy walk finds for each query, nearest first."""
        queries = queries.astype(np.float32)
        q, lengths = len(queries), (queries**2).sum(1)
        best = np.full((q, beam), -1, np.int32)
        far = np.full((q, beam), np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        best[:, 0] = self.start
        far[:, 0] = self._distances(queries, lengths, best[:, :1])[:, 0]
        open_[:, 0] = True
        active = np.arange(q)
        while len(active):
            # the nearest points that are not yet expanded, a few at a time
            rank = np.where(open_[active], far[active], np.inf)
            width = min(4, beam)
            pick = np.argpartition(rank, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(active), 1))
            rows = np.arange(len(active))[:, None]
            valid = np.isfinite(rank[rows, pick])
            nodes = np.where(valid, best[active[:, None], pick], -1)
            open_[active[:, None], pick] = False
            fresh = np.where(nodes[:, :, None] < 0, -1, self.edges[np.maximum(nodes, 0)]).reshape(len(active), -1)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            # what the beam already holds is not new
            held = np.sort(best[active], axis=1)
            base = (np.arange(len(active), dtype=np.int64) * (len(self.points) + 1))[:, None]
            known = (held + 1 + base).ravel()
            slot = np.searchsorted(known, (fresh + 1 + base).ravel()).clip(0, len(known) - 1)
            fresh[(known[slot] == (fresh + 1 + base).ravel()).reshape(fresh.shape)] = -1
            distance = self._distances(queries[active], lengths[active], fresh)
            all_far = np.concatenate([far[active], distance], axis=1)
            all_best = np.concatenate([best[active], fresh], axis=1)
            all_open = np.concatenate([open_[active], fresh >= 0], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[active], best[active] = all_far[rows, keep], all_best[rows, keep]
            open_[active] = all_open[rows, keep] & (best[active] >= 0)
            active = active[open_[active].any(1)]
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)

    def _prune(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """At most ``degree`` diverse neighbours of each node out of its row of candidates."""
        found = np.sort(np.where(found == nodes[:, None], -1, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        own = self.points[nodes]
        far = self._distances(own, self.norms[nodes], found)
        order = np.argsort(far, axis=1, kind="stable")[:, : 3 * self.degree]
        found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
        vectors = self.points[np.maximum(found, 0)]
        between = np.einsum("ncd,nkd->nck", vectors, vectors, optimize=True)
        norms = self.norms[np.maximum(found, 0)]
        between = norms[:, :, None] + norms[:, None, :] - 2 * between
        alive = found >= 0
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        rows, count = np.arange(len(nodes)), np.zeros(len(nodes), int)
        for _ in range(self.degree):
            if not alive.any():
                break
            first = alive.argmax(1)
            some = alive[rows, first]
            kept[rows[some], count[some]] = found[rows[some], first[some]]
            count[some] += 1
            # squared distances: the factor is squared as well
            covered = self.relaxed**2 * between[rows, first] <= far
            alive &= ~(covered & some[:, None])
            alive[rows, first] = False
        return kept

    def _insert(self, nodes: np.ndarray) -> None:
        proposed, _ = self.search(self.points[nodes], self.beam)
        kept = self._prune(nodes, np.concatenate([proposed, self.edges[nodes]], axis=1))
        self.edges[nodes] = kept
        # edges back, as far as there is room; full nodes are pruned anew
        to = kept.ravel()
        source = np.repeat(nodes, kept.shape[1])[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, begin, n_new = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(targets), 4096):
            part, width = slice(at, at + 4096), int(n_new[at : at + 4096].max(initial=0))
            offsets = np.minimum(np.arange(width)[None, :], n_new[part][:, None] - 1)
            incoming = np.where(np.arange(width)[None, :] < n_new[part][:, None], source[begin[part][:, None] + offsets], -1)
            both = np.concatenate([self.edges[targets[part]], incoming], axis=1)
            room = (np.sort(both, axis=1) >= 0).sum(1) <= self.degree
            packed = -np.sort(-both, axis=1)
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
            light, heavy = np.flatnonzero(room), np.flatnonzero(~room)
            self.edges[targets[part][light]] = packed[light, : self.degree]
            for sub in range(0, len(heavy), 512):
                some = heavy[sub : sub + 512]
                # a point that many new ones choose takes its nearest of them
                self.edges[targets[part][some]] = self._prune(targets[part][some], both[some])


def same_length(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component, after which all are as long as the longest."""
    norms = (vectors**2).sum(1)
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, norms.max(initial=0.0) - norms))[:, None]])


def _search_shard(k: int, beam: int, block: int):
    """Answers rows that come by shard, each shard's points (kind 0) before its queries: the graph is built once from
    the points, then every block of queries is answered and let go."""

    def answer(graph: Graph, vectors: np.ndarray, ids: pa.Array, asked: pa.RecordBatch) -> pa.RecordBatch:
        part = matrix(asked.column("vector"))
        found, _ = graph.search(np.hstack([part, np.zeros((len(part), 1))]), beam)
        exact = np.einsum("qd,qcd->qc", part, vectors[np.maximum(found, 0)])
        exact[found < 0] = -np.inf
        best = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
        rows = np.arange(len(part))[:, None]
        there = found[rows, best] >= 0
        query = np.broadcast_to(rows, best.shape)[there]
        return pa.RecordBatch.from_arrays(
            [asked.column("id").take(pa.array(query)), ids.take(pa.array(found[rows, best][there])),
             pa.array(exact[rows, best][there])], names=["query_id", "point", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, graph, vectors, ids = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch may hold the end of one shard and the start of others
            at = np.stack([batch.column("shard").to_numpy(), batch.column("kind").to_numpy()])
            starts = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1])
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
                run, (shard, kind) = batch.slice(start, end - start), at[:, start]
                if shard != now:
                    now, points, graph, vectors, ids = shard, [], None, None, None
                if kind == 0:
                    # only what the graph needs: a slice would hold on to its whole batch
                    points.append((matrix(run.column("vector")), pa.concat_arrays([run.column("id")])))
                    continue
                if graph is None and points:
                    vectors, ids = np.concatenate([v for v, _ in points]), pa.concat_arrays([i for _, i in points])
                    points, graph = [], Graph(same_length(vectors))
                if graph is not None:
                    for first in range(0, run.num_rows, block):
                        yield answer(graph, vectors, ids, run.slice(first, block))

    return search


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 8_192, beam: int = 96, query_block: int = 512, query_rows: int = 65_536,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest that were found for every row for which ``queries`` is true.

    A shard holds about ``shard_rows`` distinct vectors of one length and sees all queries of that length. Each shard is
    a task of its own, and one more for every further ``query_rows`` queries: a task builds the graph of its shard, then
    holds one batch of queries at a time. So queries times shards are walks: with both growing, time grows with the
    product.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sound = cut(rows.withColumn("length", F.size("vector")), "ann-vectors")
    # -0.0 and 0.0 are one value to a grouping, as they are to a product
    points = cut(
        sound.groupBy("length", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "ann-points"
    )
    asked = sound.where("asked").select("length", "id", "vector").distinct()
    # one row per length of vectors: how many shards, how many tasks a shard, and the number of its first task
    before = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(
        points.groupBy("length").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
        .join(asked.groupBy("length").agg(F.ceil(F.count("*") / query_rows).alias("chunks")), "length")
        .withColumn("first", F.coalesce(F.sum(F.col("shards") * F.col("chunks")).over(before), F.lit(0))), "ann-plan"
    )
    tasks = plan.agg(F.coalesce(F.sum(F.col("shards") * F.col("chunks")), F.lit(1)).alias("n")).first()["n"]
    kind = sound.schema["id"].dataType.simpleString()

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    shard = (F.col("first") + F.col("part") * F.col("chunks") + F.col("chunk")).alias("shard")
    own = points.join(plan, "length").withColumn("part", F.pmod(F.xxhash64("id"), F.col("shards"))).select(
        "*", every("chunks").alias("chunk")).select(shard, F.lit(0).alias("kind"), "id", "vector")
    everywhere = asked.join(plan, "length").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks"))).select(
        "*", every("shards").alias("part")).select(shard, F.lit(1).alias("kind"), "id", "vector")
    # sorted by Spark, on disk where need be, so that queries stream past the graph of their shard
    dealt = own.unionByName(everywhere).repartitionById(int(tasks), F.col("shard").cast("int"))
    dealt = dealt.sortWithinPartitions("shard", "kind", "id")
    found = cut(
        dealt.mapInArrow(_search_shard(k, beam, query_block), f"query_id {kind}, point {kind}, score double"), "ann-found"
    )
    # the nearest k + 1 points hold the nearest k ids; of a point's copies its k + 1 smallest ids can be among them
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "point")
    kept = found.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k + 1).drop("place")
    alike = points.where("copies > 1").select("vector", F.col("id").alias("point"))
    members = (
        sound.join(alike, "vector").select("point", "id")
        .withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("id")))
        .where(F.col("n") <= k + 1).drop("n")
    )
    alone = points.where("copies = 1").select(F.col("id").alias("point"), "id")
    candidates = kept.join(members.unionByName(alone), "point").where(F.col("id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        candidates.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
