"""Near-duplicate documents by HyperMinHash registers, with every link confirmed on full shingle sets.

A document is its set of distinct five-word shingles, hashed to 64 bits. The hash picks one of ``REGISTERS`` buckets;
a bucket keeps the smallest remaining value as its number of leading zeros and ``MANTISSA`` bits after them. An empty
bucket copies the first occupied one of its own fixed order, so short documents have full sketches as well.
``ROWS`` registers make a band; documents with an equal band meet in its bucket.

Documents with equal sets are one class. Classes are linked in three rounds, each of which proposes pairs, keeps those
whose collision-corrected Jaccard estimate can be at the threshold, confirms them on the full sets, and joins what is
linked into groups:

1. and 2. in each bucket that still holds several groups, one member against the others (first the first quarter of
   the bands, then the rest), which joins the bulk of any group of copies with as many pairs as members;
3. in the buckets that still hold several groups, all members outside the largest group against all of the bucket, so
   that no link between two groups is left out. A pair is compared only in the first band that it shares, and not at
   all once its groups are joined; sets are compared where the rows meet, and only links come out.

So pairs within a group that is already joined are never made. Buckets of any size are cut into blocks.

Defined results: a text without words, or null, has an empty set and links with nothing; a text of fewer than five
words is one shingle; rows that repeat a doc_id and a text are one document of the same class; rows without doc_id link
with nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, cut, small_batches
from fleetlens.session import ship_package

REGISTERS = 384
ROWS = 8
BANDS = REGISTERS // ROWS
MANTISSA = 8
VALUE_BITS = 48
SHINGLE = 5
BLOCK = 512
BLOCK_BYTES = 4 << 20
# Odd 64-bit constants for mixing.
ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
     0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93], np.uint64,
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[6]
    x = (x ^ (x >> np.uint64(27))) * ODD[5]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    # bytes: lower() changes A-Z alone, and split() knows the six ASCII white spaces alone
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(words) - SHINGLE + 1
    total = hashed[:last] * ODD[0]
    for k in range(1, SHINGLE):
        total = _mixed(total) + hashed[k : last + k] * ODD[k]
    return np.unique(_mixed(total))


_orders: list[np.ndarray] = []


def _order() -> np.ndarray:
    """Each register's fixed order of all registers, from which an empty one is filled."""
    if not _orders:
        draw = np.random.default_rng(20)
        _orders.append(np.stack([draw.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.int32))
    return _orders[0]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (leading zeros and mantissa bits) of a non-empty set of hashes."""
    mixed = _mixed(hashes + ODD[7])
    bucket = (mixed >> np.uint64(VALUE_BITS)) % np.uint64(REGISTERS)
    value = mixed & np.uint64((1 << VALUE_BITS) - 1)
    least = np.full(REGISTERS, np.uint64(1 << VALUE_BITS), np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), value)
    occupied = least < np.uint64(1 << VALUE_BITS)
    fraction, exponent = np.frexp((least + np.uint64(1)).astype(np.float64))
    zeros = np.minimum(VALUE_BITS + 1 - exponent, 63)
    registers = (zeros << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    if not occupied.all():
        empty = np.flatnonzero(~occupied)
        order = _order()
        for width in (16, REGISTERS):
            tried = order[empty, :width]
            hit = occupied[tried]
            some = hit.any(1)
            registers[empty[some]] = registers[tried[some, hit[some].argmax(1)]]
            empty = empty[~some]
            if not len(empty):
                break
    return registers.astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of registers."""
    bands = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[7], bands.shape[:2]).copy()
    for k in range(ROWS):
        key = _mixed(key + bands[:, :, k] * ODD[k % len(ODD)] + ODD[(k + 3) % len(ODD)])
    return key.view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely registers of two sets without a common element are equal: the same leading zeros, then mantissa."""
    level = np.arange(VALUE_BITS)[None, :]
    above, below = 0.5**level, 0.5 ** (level + 1)
    total = np.ones((len(n_a), VALUE_BITS))
    for n in (n_a, n_b):
        load = np.maximum(n / REGISTERS, 1.0)[:, None]  # a filled bucket has at least one
        total = total * (np.exp(-load * below) - np.exp(-load * above))
    return total.sum(1) / (1 << MANTISSA)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the Jaccard estimate, corrected for collisions, is within four standard errors of the threshold, and
    the set sizes allow it."""
    equal = (a == b).mean(1)
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    t = percent / 100
    error = np.sqrt(t * (1 - t) / np.minimum(REGISTERS, low))
    accidental = chance(n_a, n_b)
    estimate = (equal - accidental) / (1 - accidental)
    return (estimate >= t - 4 * error) & (100 * low >= percent * high)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1000):
            sizes, keys, sketches = [], [], []
            for text in part.column("text"):
                found = shingles(text.as_py())
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketches.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        build, f"doc_id {kind}, n_shingles long, set_key binary, sketch binary"
    )


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    """(rep, bands): the keys of all bands of each class, in their order."""
    kind = classes.schema["rep"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 2000):
            keys = band_keys(_registers(part.column("sketch")))
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["rep", "bands"])

    return classes.select("rep", "sketch").mapInArrow(spread, f"rep {kind}, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, hashes) of the classes: full sets, computed again from whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 200):
            reps, found = [], []
            for rep, key, text in zip(part.column("rep").to_pylist(), part.column("set_key").to_pylist(), part.column("text")):
                raw = shingles(text.as_py()).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == key:  # a doc_id may have had several texts
                    reps.append(rep), found.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, part.schema.field("rep").type), pa.array(found, pa.binary())], names=["rep", "hashes"]
            )

    wanted = docs.select(F.col("doc_id").alias("rep"), "text").join(classes.select("rep", "set_key"), "rep")
    return wanted.mapInArrow(build, f"rep {kind}, hashes binary")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that begin and end with a whole (key, i, j), from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0))
        if len(new):
            at = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
    starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1])
    return starts, np.append(starts[1:], ids.shape[1])


def _propose(percent: int):
    """Pairs of the first row of each block (rows come in the order of their hash) with the others."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches):
            starts, ends = _bounds(table)
            reps, labels = table.column("rep").to_numpy(), table.column("group").to_numpy()
            sizes = table.column("n_shingles").to_numpy()
            registers = _registers(table.column("sketch").combine_chunks())
            hub = np.repeat(starts, ends - starts)
            rows = np.flatnonzero(labels != labels[hub])
            for at in range(0, len(rows), 4096):
                x, y = rows[at : at + 4096], hub[rows[at : at + 4096]]
                fits = plausible(registers[x], registers[y], sizes[x], sizes[y], percent)
                x, y = reps[x[fits]], reps[y[fits]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return propose


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets, sorted, share enough of their union."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _settle(percent: int):
    """Confirmed links between groups: in each block, rows outside the bucket's largest group against its rows. A pair
    whose groups a link of this block has joined already is skipped, so at most one link per row comes out."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches):
            table = table.combine_chunks()
            found: list[tuple] = []
            for a, b in zip(*_bounds(table)):
                block = table.slice(a, b - a)
                reps, side = block.column("rep").to_numpy(), block.column("side").to_numpy()
                sizes, band = block.column("n_shingles").to_numpy(), block.column("band").to_numpy()
                minor = block.column("minor").to_numpy() == 1
                joined = np.unique(block.column("group").to_numpy(), return_inverse=True)[1]
                registers = _registers(block.column("sketch").combine_chunks())
                hashes = block.column("hashes").combine_chunks()
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                step = max(1, 8192 // max(1, len(right)))
                for at in range(0, len(left), step):
                    x = np.repeat(left[at : at + step], len(right))
                    y = np.tile(right, len(left[at : at + step]))
                    # two rows outside the largest group meet twice and are compared once
                    some = (joined[x] != joined[y]) & (~(minor[x] & minor[y]) | (reps[x] < reps[y]))
                    some &= 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
                    x, y = x[some], y[some]
                    if not len(x):
                        continue
                    equal = registers[x] == registers[y]
                    first = equal.reshape(len(x), BANDS, ROWS).all(2).argmax(1) == band[x]
                    x, y, likeness = x[first], y[first], equal[first].mean(1)
                    fits = plausible(registers[x], registers[y], sizes[x], sizes[y], percent)
                    x, y, likeness = x[fits], y[fits], likeness[fits]
                    for n in np.argsort(-likeness, kind="stable"):
                        u, v = int(x[n]), int(y[n])
                        if joined[u] != joined[v] and _reaches(
                            np.frombuffer(hashes[u].as_buffer(), np.uint64),
                            np.frombuffer(hashes[v].as_buffer(), np.uint64), percent,
                        ):
                            joined[joined == joined[u]] = joined[v]
                            found.append((min(reps[u], reps[v]), max(reps[u], reps[v])))
            kind = table.schema.field("rep").type
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], names=["a", "b"])

    return settle


def _open_buckets(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of buckets whose members are of several groups, with each member's group."""
    if groups is None:
        return buckets.withColumn("group", F.col("rep"))
    known = buckets.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "key", "band", "rep", F.coalesce("component", "rep").alias("group")
    )
    several = known.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    return known.join(cut(several.select("key"), "open-keys"), "key", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, exactly."""
    kind = pairs.schema["a"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("of_a"), batch.column("of_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("of_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("hashes").alias("of_b")), "b"
    )
    return with_sets.select("a", "b", "of_a", "of_b").mapInArrow(confirm, f"a {kind}, b {kind}")


def _dealt(blocks: DataFrame, dressing: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with what they are compared by, each block whole and in one task, in the order of a hash."""
    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "i", "j", "turn", "rep"]
    joined = blocks.join(dressing, "rep").repartition(n, "key", "i", "j")
    return joined.sortWithinPartitions(*order).select(*columns, *(c for c in dressing.columns if c != "rep"))


def _by_stars(rows: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of one row per block of a bucket with the others of its block, confirmed."""
    kind = rows.schema["rep"].dataType.simpleString()
    turn = F.xxhash64("rep", F.lit(11))
    parts = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1"), "large-buckets")
    blocks = rows.join(parts, "key", "left").withColumns({
        "turn": turn, "i": F.pmod(turn, F.coalesce("parts", F.lit(1).cast("long"))), "j": F.lit(0).cast("long"),
    })
    dealt = _dealt(blocks.drop("parts", "band"), sketches, ["key", "i", "j", "rep", "group"])
    pairs = cut(dealt.mapInArrow(_propose(percent), f"a {kind}, b {kind}").distinct(), "doc-pairs")
    return _confirmed(pairs, sets, percent)


def _by_all(rows: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the groups of a bucket: blocks of rows outside the largest group meet blocks of all rows."""
    kind = rows.schema["rep"].dataType.simpleString()
    zero = F.lit(0).cast("long")
    # blocks are of so many rows and so many bytes
    per_group = rows.join(sketches.select("rep", "n_shingles"), "rep").groupBy("key", "group").agg(
        F.count("*").alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))

    sizes = per_group.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "group", "bytes")).alias("largest")
    ).select(
        "key", F.col("largest.group").alias("largest"), parts(F.col("n"), F.col("bytes")).alias("parts"),
        parts(F.col("n") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes")).alias("minor_parts"),
    )
    sizes = cut(sizes, "bucket-sizes")
    known = rows.join(sizes, "key").withColumns({
        "minor": (F.col("group") != F.col("largest")).cast("int"), "turn": F.xxhash64("rep", F.lit(11)),
    })
    left = known.where("minor = 1").withColumns({
        "side": F.lit(0), "i": F.pmod("turn", F.col("minor_parts"))
    }).withColumn("j", F.explode(F.sequence(zero, F.col("parts") - 1)))
    right = known.withColumns({
        "side": F.lit(1), "j": F.pmod(F.xxhash64("rep", F.lit(12)), F.col("parts"))
    }).withColumn("i", F.explode(F.sequence(zero, F.col("minor_parts") - 1)))
    blocks = left.unionByName(right).drop("largest", "parts", "minor_parts")
    dealt = _dealt(blocks, sketches.join(sets, "rep"), ["key", "i", "j", "side", "minor", "band", "rep", "group"])
    return dealt.mapInArrow(_settle(percent), f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links are pairs of documents whose shared shingles are
    at least ``percent`` in a hundred of their union; a component is named by its smallest doc_id."""
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), percent)


def _near_duplicates(texts: DataFrame, percent: int) -> DataFrame:
    every = cut(_sketches(texts), "doc-sketches")
    sound = every.where("doc_id is not null and n_shingles > 0")
    firsts = sound.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    # the key holds the id, so that a large class of copies is not one task's
    classes = cut(
        sound.join(firsts, ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"])
        .withColumnRenamed("doc_id", "rep"),
        "doc-classes",
    )
    bands = cut(_bands(classes), "doc-bands").select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    # stored first: of known size, it is sent to the tasks where it is small, and else hot keys are split where they join
    buckets = cut(bands.join(cut(shared.select("key"), "shared-keys"), "key", "left_semi"), "doc-buckets")
    met = cut(classes.join(buckets.select("rep").distinct(), "rep", "left_semi"), "doc-met")
    sketches = met.select("rep", "n_shingles", "sketch")
    sets = cut(_sets(texts, met), "doc-sets")
    links = cut(_by_stars(_open_buckets(buckets.where(F.col("band") < BANDS // 4), None), sketches, sets, percent), "doc-links")
    groups = cut(components(links), "doc-groups")
    for last in (False, True):
        rows = cut(_open_buckets(buckets if last else buckets.where(F.col("band") >= BANDS // 4), groups), "open-buckets")
        found = (_by_all if last else _by_stars)(rows, sketches, sets, percent)
        # what is already joined counts as one star per group
        stars = groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        groups = cut(components(stars.union(cut(found, "doc-links"))), "doc-groups")
    # one row per set; a set that fills much of the table is split where it is joined
    named = classes.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    joined = every.join(named, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
