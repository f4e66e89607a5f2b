"""Embedding near-duplicates by an exact metric range join.

Vectors of a label are compared as unit vectors, where a cosine of at least c is a Euclidean distance of at most
r = sqrt(2 - 2c). Every vector is at home in the cell of its nearest pivot. By the triangle inequality, whatever lies
within r of it can be at home only in cells whose pivot is no more than 2r farther from it than its own. Two vectors are
compared in the cell with the smaller number of their two, so a vector is replicated only to cells before its own that
the bound leaves open, and each pair is compared once, in one cell, and counted for both. Cells larger than a block are
cut into pairs of blocks. A block emits, per vector, how many links it found, and one row per vector of each of its
connected groups, never the pairs; groups of all blocks are joined into components.

Pivots are chosen per label and length of vectors, farthest first, from a sample of its vectors. How many is read off
that sample: of 8, 16, 32, ... the number for which vectors times replicas and products cost least. Where vectors
cluster, most cells lie beyond the bound; where all of them lie at like distances, no number of pivots prunes much, few
are taken, and the join is one of blocks. A label of no more than a block of vectors has one cell.

Equal vectors of a label are one class, joined as one with its number of copies.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without label or id, link
with nothing and are their own component; vectors of different length never link; repeated rows are vectors of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, cut
from fleetlens.llm.vectors import matrix, usable
from fleetlens.session import ship_package


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def farthest_first(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the unit vectors, each the farthest from those before it."""
    chosen = [0]
    far = 2 - 2 * (sample @ sample[0])
    while len(chosen) < min(most, len(sample)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * (sample @ sample[chosen[-1]]))
    return sample[chosen]


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and whether a partner may be at home in each cell up to it."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))
    home = far.argmin(1)
    reached = far <= far.min(1, keepdims=True) + 2 * radius + 1e-7
    return home, reached & (np.arange(len(pivots))[None, :] <= home[:, None])


def choose_pivots(sample: np.ndarray, rows: int, radius: float, most: int) -> np.ndarray:
    """Pivots for ``rows`` vectors of which the unit vectors of ``sample`` are some.

    The cost of a number of pivots is the products that it leaves, plus what a replica costs to move, taken as 512
    products. Fewer pivots are kept unless more save a tenth.
    """
    every = farthest_first(sample, most)
    best, least, n = every[:1], np.inf, min(8, len(every))
    while True:
        home, cells = cells_of(sample, every[:n], radius)
        own = np.bincount(home, minlength=n) / len(sample) * rows
        copies = cells.sum(0) / len(sample) * rows - own
        cost = (own * (own / 2 + copies)).sum() + 512 * copies.sum() + rows * n
        if cost < 0.9 * least:
            best, least = every[:n], cost
        if n == len(every):
            return best
        n = min(2 * n, len(every))


def replicated(classes: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """(label, cell, home, id, copies, vector): each class in its home cell and in those before it that its partners may
    be at home in. Cells are of one label and length; those without pivots are one cell."""
    label = classes.schema["label"].dataType.simpleString()
    vector = classes.schema["vector"].dataType.simpleString()
    own = classes.schema["id"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            lengths = np.array(batch.column("vector").value_lengths())
            labels = batch.column("label").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(labels, lengths.tolist())):
                groups.setdefault(key, []).append(row)
            rows, cells, homes = [], [], []
            for key, members in groups.items():
                members = np.array(members)
                if key in pivots:
                    x = _unit(matrix(batch.column("vector").take(pa.array(members))))
                    home, open_ = cells_of(x, pivots[key], radius)
                    at, cell = np.nonzero(open_)
                    rows.append(members[at]), cells.append(cell), homes.append(home[at] == cell)
                else:
                    rows.append(members), cells.append(np.zeros(len(members), int)), homes.append(np.ones(len(members), bool))
            if not rows:
                continue
            rows = np.concatenate(rows).astype(np.int64)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [picked.column("label"), pa.array((np.concatenate(cells) + (lengths[rows].astype(np.int64) << 32))),
                 pa.array(np.concatenate(homes).astype(bool)), picked.column("id"), picked.column("copies"),
                 picked.column("vector")],
                names=["label", "cell", "home", "id", "copies", "vector"],
            )

    return classes.select("label", "id", "copies", "vector").mapInArrow(
        deal, f"label {label}, cell long, home boolean, id {own}, copies long, vector {vector}"
    )


def _blocks(cells: DataFrame, rows: int) -> DataFrame:
    """Rows of (label, cell, away, i, j): block i of a cell's own vectors meets its own block j from i on (``away``
    false) or block j of the replicas there (``away`` true); ``side`` 0 is the block i."""
    sizes = cells.groupBy("label", "cell").agg(
        F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home")
    ).where("n_home > 0 and n > 1").select(
        "label", "cell", F.ceil(F.col("n_home") / rows).alias("own"), F.ceil((F.col("n") - F.col("n_home")) / rows).alias("away"),
    )
    known = cells.join(cut(sizes, "vector-cell-sizes"), ["label", "cell"])
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.when(F.col("home"), F.col("own")).otherwise(F.col("away")), F.lit(1)))

    def numbers(last: Column) -> Column:
        # sequence counts down where the end is before the start
        return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda n: n <= last)

    def task(away: bool, i: Column, j: Column, side: int) -> Column:
        return F.struct(F.lit(away).alias("away"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    b = F.col("_block")
    own = F.concat(
        F.transform(numbers(F.col("own") - 1 - b), lambda n: task(False, b, b + n, 0)),
        F.transform(numbers(b - 1), lambda n: task(False, n, b, 1)),
        F.transform(numbers(F.col("away") - 1), lambda n: task(True, b, n, 0)),
    )
    away = F.transform(numbers(F.col("own") - 1), lambda n: task(True, n, b, 1))
    dealt = known.withColumn("_block", block).select(
        "label", "cell", "id", "copies", "vector", F.explode(F.when(F.col("home"), own).otherwise(away)).alias("_task"))
    return dealt.select("label", "cell", "_task.*", "id", "copies", "vector")


def _join_block(cosine: float):
    """Links between the two sides of a block, or within its only side, each counted for both ends."""

    def join(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        ids, copies = block.column("id").to_numpy(), block.column("copies").to_numpy()
        vectors = _unit(matrix(block.column("vector")))
        # one row per class on each side: ids are places
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right) and not block.column("away")[0].as_py() and block.column("i")[0] == block.column("j")[0]
        right = left if alone else right
        group, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for at in range(0, len(left), 256):  # a strip at a time: its products are what is held
            own = left[at : at + 256]
            near = (vectors[own] @ vectors[right].T) >= cosine
            if alone:  # each pair once
                near &= np.arange(len(right))[None, :] > np.arange(at, at + len(own))[:, None]
            links[own] += near.astype(np.int64) @ copies[right]
            links[right] += copies[own] @ near.astype(np.int64)
            a, b = np.nonzero(near)
            # roots of linked vectors are hooked to the smaller one until all links lie within groups
            a, b = own[a], right[b]
            while len(a):
                low = np.minimum(group[a], group[b])
                before = group.copy()
                np.minimum.at(group, group[a], low), np.minimum.at(group, group[b], low)
                while not np.array_equal(group, group[group]):
                    group = group[group]
                if np.array_equal(before, group):
                    break
        grouped = np.flatnonzero((group != np.arange(len(ids))) | (links > 0))
        return pa.table({
            "id": pa.array(ids[grouped]), "links": pa.array(links[grouped]), "root": pa.array(ids[group[grouped]]),
        })

    return join


def _sampled_pivots(classes: DataFrame, radius: float, block_rows: int, most: int, sample_rows: int) -> dict[tuple, np.ndarray]:
    """Pivots of the labels and lengths that are larger than a block: at most ``most`` in all, from at most
    ``sample_rows`` vectors, both dealt in proportion to their classes. That is what the driver holds."""
    size = F.size("vector")
    large = classes.groupBy("label", size.alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    # the largest: each has a share of two pivots at least
    rows = large.orderBy(F.desc("n"), "label", "length").limit(most // 2).collect()
    total = sum(r["n"] for r in rows)
    if not total:
        return {}
    thinned = classes.withColumn("length", size).join(large.select("label", "length"), ["label", "length"], "left_semi").where(
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample_rows / total) * (1 << 30)))
    sample: dict[tuple, list] = {}
    for r in thinned.select("label", "length", "vector").orderBy(F.xxhash64("id", F.lit(4)), "id").limit(sample_rows).collect():
        sample.setdefault((r["label"], r["length"]), []).append(r["vector"])
    found = {}
    for r in rows:
        key = (r["label"], r["length"])
        if key in sample:
            share = max(2, int(most * r["n"] / total))
            found[key] = choose_pivots(_unit(np.array(sample[key], np.float64)), r["n"], radius, share)
    return found


def near_vectors(
    vectors: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", pivots: int = 1024, block_rows: int = 2048, sample_rows: int = 16_384,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: how many other vectors of its label have a cosine of at least
    ``cosine``, and the smallest id that links reach. At most ``pivots`` vectors of all labels become pivots, out of a
    sample of at most ``sample_rows`` that the driver holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    sound = rows.where(takes_part)
    # classes have numbers of their own, stored, as an id may have several vectors
    classes = cut(
        sound.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()), "vector-classes"
    )
    radius = float(np.sqrt(2 - 2 * cosine))
    points = _sampled_pivots(classes, radius, block_rows, pivots, sample_rows)
    cells = cut(replicated(classes, points, radius), "vector-cells")
    found = cut(
        _blocks(cells, block_rows).groupBy("label", "cell", "away", "i", "j")
        .applyInArrow(_join_block(cosine), "id long, links long, root long"),
        "vector-links",
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # a component is named by the smallest id of its classes
    linked = classes.select("id", "low").join(groups, "id")
    names = cut(linked.groupBy("component").agg(F.min("low").alias("name")), "component-names")
    named = cut(groups.join(names, "component").select("id", "name"), "class-names")
    numbered = (
        classes.join(links, "id", "left").join(named, "id", "left")
        .select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("name", "low").alias("component_id"))
    )
    joined = sound.join(numbered, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
