"""Centroid clustering by Lloyd's rounds on vectors whose dimensions are sharded.

Components become integers, so all sums and distances are exact. The kept vectors are cut into pieces of rows and each
piece into blocks of dimensions; the blocks are stored in a table that is bucketed by piece. In a round, the task of a
block computes the partial squared distances of its rows to its slice of the centroids, as one row per piece and block.
These are added by piece, which gives each row its nearest centroid, and the assignments meet the stored blocks again,
bucket by bucket: each block sums its own dimensions per centroid. So per round only partial distances are shuffled, and
the driver sees one number per centroid and dimension.

Defined results: a vector takes part if it has exactly ``dims`` components, none of them null or not finite, and none so
large that a squared distance might not fit 64 bits (for 64 dimensions and a scale of 1024: 131,072 or more); others
have no row. Rows of equal id are vectors of their own; where their hashes tie for a first centroid, the smaller
vector is taken first. A null id hashes as the empty text. With fewer than ``k`` kept vectors each of them is a first
centroid; with none, or from an empty table, there are no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import cut
from fleetlens.llm.vectors import matrix
from fleetlens.session import scratch_folder, ship_package

LARGEST = 1 << 27


def takes_part(vector: Column, dims: int, scale: int) -> Column:
    """True for a vector of ``dims`` components whose integers and distances can be held."""
    bound = min(LARGEST, int((2**62 / dims) ** 0.5) // 2) / scale
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64)


def _pieces(kept: DataFrame, block_dims: int, scale: int, rows: int) -> DataFrame:
    """(piece, block, ids, numbers): rows of one piece in one block of dimensions; ids with the first block only."""
    own = kept.schema["id"].dataType.simpleString()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                numbers = _integers(matrix(part.column("vector")), scale).astype(np.int32)
                ids = part.column("id")
                offsets = pa.array([0, len(ids)], pa.int32())
                for block, first in enumerate(range(0, numbers.shape[1], block_dims)):
                    held = pa.ListArray.from_arrays(offsets, ids) if not block else pa.nulls(1, pa.list_(ids.type))
                    raw = np.ascontiguousarray(numbers[:, first : first + block_dims]).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([piece]), pa.array([block], pa.int32()), held, pa.array([raw], pa.binary())],
                        names=["piece", "block", "ids", "numbers"],
                    )
                piece += 1

    return kept.mapInArrow(shard, f"piece long, block int, ids array<{own}>, numbers binary")


def _partial(centroids: np.ndarray, block_dims: int):
    """Squared distances of a block's rows to its slice of the centroids, centroid by centroid."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (block, raw) in enumerate(zip(batch.column("block").to_pylist(), batch.column("numbers"))):
                own = centroids[:, block * block_dims : (block + 1) * block_dims]
                numbers = np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, own.shape[1]).astype(np.int64)
                found = np.empty((len(own), len(numbers)), np.int64)
                for c, centroid in enumerate(own):
                    away = numbers - centroid
                    found[c] = np.einsum("ij,ij->i", away, away)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("piece").slice(n, 1), pa.array([found.tobytes()], pa.binary())], names=["piece", "far"])

    return partial


def _nearest(k: int):
    """Adds the partial distances of a piece; ties go to the smaller number."""

    def nearest(parts: pa.Table) -> pa.Table:
        total = None
        for raw in parts.column("far"):
            far = np.frombuffer(raw.as_buffer(), np.int64)
            total = far.copy() if total is None else np.add(total, far, out=total)
        far = total.reshape(k, -1)
        cluster = far.argmin(0)
        return pa.table({
            "piece": parts.column("piece").slice(0, 1),
            "clusters": pa.array([cluster.astype(np.int32).tobytes()], pa.binary()),
            "distances": pa.array([far[cluster, np.arange(far.shape[1])].tobytes()], pa.binary()),
        })

    return nearest


def _sums(k: int, dims: int, block_dims: int):
    """(block, cluster, n, sums): what a task's blocks add up to, per centroid that has rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, numbers, clusters in zip(batch.column("block").to_pylist(), batch.column("numbers"), batch.column("clusters")):
                width = min(block_dims, dims - block * block_dims)
                values = np.frombuffer(numbers.as_buffer(), np.int32).reshape(-1, width)
                of = np.frombuffer(clusters.as_buffer(), np.int32)
                n, sums = total.setdefault(block, (np.zeros(k, np.int64), np.zeros((k, width), np.int64)))
                n += np.bincount(of, minlength=k)
                order = np.argsort(of, kind="stable")
                there, begins = np.unique(of[order], return_index=True)
                sums[there] += np.add.reduceat(values[order].astype(np.int64), begins, axis=0)
        rows = [(b, c, int(n[c]), sums[c]) for b, (n, sums) in total.items() for c in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["block", "cluster", "n", "sums"],
        )

    return add


def _moved(blocks: DataFrame, centroids: np.ndarray, block_dims: int) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors; empty ones stay."""
    k, dims = centroids.shape
    of_pieces = _assigned(blocks, centroids, block_dims).select("piece", "clusters")
    met = blocks.select("piece", "block", "numbers").join(of_pieces, "piece")
    parts = met.select("block", "numbers", "clusters").mapInArrow(
        _sums(k, dims, block_dims), "block int, cluster int, n long, sums array<long>")
    totals = parts.select("block", "cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("block", "cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    exact = totals.select(
        "block", "cluster", "at", F.expr("(total - pmod(total, CAST(n AS DECIMAL(20,0)))) div n").alias("mean"))
    after = centroids.copy()
    for r in exact.collect():  # one row per centroid and dimension
        after[r["cluster"], r["block"] * block_dims + r["at"]] = r["mean"]
    return after


def _assigned(blocks: DataFrame, centroids: np.ndarray, block_dims: int) -> DataFrame:
    """(piece, clusters, distances): the nearest centroid of each of a piece's rows, in their order."""
    far = blocks.select("piece", "block", "numbers").mapInArrow(_partial(centroids, block_dims), "piece long, far binary")
    return far.groupBy("piece").applyInArrow(
        _nearest(len(centroids)), "piece long, clusters binary, distances binary")


def _bucketed(pieces: DataFrame) -> tuple[DataFrame, str]:
    """The blocks in files by hash of their piece, so that what is keyed by piece joins them without moving them."""
    spark = pieces.sparkSession
    name, n = f"lloyd_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_folder(spark, "lloyd-blocks")
    shuffled = pieces.repartition(n, "piece")
    shuffled.write.format("parquet").bucketBy(n, "piece").sortBy("piece").option("path", path).saveAsTable(name)
    return spark.table(name), name


def first_centroids(kept: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The integers of the ``k`` vectors whose salted id has the smallest SHA-256, in its order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    return np.array([_integers(np.array(r["vector"], np.float64), scale) for r in rows], np.int64)


def lloyd(
    vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, block_dims: int = 32, scale: int = 1024,
    salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", piece_rows: int = 2048,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    Components are floor(``scale`` * x). A task holds one block of one piece (``piece_rows`` * ``block_dims`` numbers),
    or the partial distances of one piece (``piece_rows`` * ``k`` for each block), and one slice of the centroids.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kept = rows.where(takes_part(F.col("vector"), dims, scale))
    own = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(kept, k, salt, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"id {own}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    # stored before it is dealt by piece: pieces are numbered where rows are read, once
    pieces = cut(_pieces(kept, block_dims, scale, piece_rows), "lloyd-pieces")
    blocks, name = _bucketed(pieces)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, block_dims)
    last = cut(_assigned(blocks, centroids, block_dims), "lloyd-assigned")
    spark.sql(f"DROP TABLE {name}")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, clusters, distances in zip(batch.column("ids"), batch.column("clusters"), batch.column("distances")):
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.frombuffer(clusters.as_buffer(), np.int32)),
                     pa.array(np.frombuffer(distances.as_buffer(), np.int64))], names=["id", "cluster", "distance"])

    of_rows = cut(
        pieces.where("block = 0").select("piece", "ids").join(last, "piece").select("ids", "clusters", "distances")
        .mapInArrow(spread, f"id {own}, cluster int, distance long"), "lloyd-rows")
    inertia = {r["cluster"]: r["inertia"] for r in of_rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    total = sum(inertia.values())
    # one row per centroid
    facts = spark.createDataFrame(
        [(c, inertia.get(c), total, digest) for c, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return of_rows.join(facts, "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
