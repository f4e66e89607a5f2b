"""Best-fit packing of token pieces into sequences of bounded length by exact complements.

Documents become ids and are cut into pieces of at most one sequence. Only the histogram of piece lengths, one
count per length, reaches the driver. There, an index of the sums of one, two and three available lengths is kept up
to date as counts run out; from the longest length down, gaps are looked up in it and filled exactly, as often as the
counts allow; what no exact sum can fill is packed best-fit. A pattern (lengths, times) then hands out places by the rank of a piece among those of its length.

Defined results: a null text is an empty one and, like it, a piece of the closing id alone; repeated rows are
separate pieces; an empty table gives no pieces; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import tokenizing
from fleetlens.llm.common import cut, running_start
from fleetlens.session import ship_package

BATCH_BYTES = 8_000_000


def token_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = 2048, closing_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit integers. ``tokenizer`` is a
    file that every executor has."""
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(tokenizing.WordEncoder, tokenizer)
        closing = closing_id.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            rows, kept = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + closing
                doc_id = doc_id.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
                kept += len(ids)
                if kept > BATCH_BYTES:
                    yield _batch(rows, names, batch.schema.field(0).type)
                    rows, kept = [], 0
            if rows:
                yield _batch(rows, names, batch.schema.field(0).type)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut_up, f"doc_id {id_type}, piece int, start long, length long, ids binary"
    )


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Sums:
    """An index of the sums of one, two and three available lengths, by sum.

    ``left`` has how many pieces of each length there are. Pairs stand in a list per sum, longer first parts first, and
    triples are a part with an entry of the list of pairs of the rest. Counts only fall: an entry that has run out never
    comes back, so each sum has a mark before which all entries are used up, for pairs and for triples.
    """

    def __init__(self, left: np.ndarray):
        self.left, capacity = left, len(left) - 1
        self.lengths = np.flatnonzero(left)[::-1]
        long, short = np.meshgrid(self.lengths, self.lengths, indexing="ij")
        fits = (long >= short) & (long + short <= capacity)
        long, short = long[fits].astype(np.int32), short[fits].astype(np.int32)
        order = np.argsort(long + short, kind="stable")  # within a sum by the longer part, as they come
        bounds = np.searchsorted((long + short)[order], np.arange(capacity + 2))
        self.pairs = [long[order[a:b]] for a, b in zip(bounds, bounds[1:])]
        self.pair_mark = [0] * (capacity + 1)
        self.triple_mark = [0] * (capacity + 1)

    def _there(self, parts: tuple[int, ...], held: tuple[int, ...] = ()) -> bool:
        need = Counter(parts + held)
        return all(self.left[p] >= need[p] for p in parts)

    def pair(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two available lengths of this sum, besides those that are held."""
        entries, mark = self.pairs[total], self.pair_mark[total]
        while mark < len(entries) and not self._there((int(entries[mark]), total - int(entries[mark]))):
            mark += 1
        self.pair_mark[total] = mark
        for at in range(mark, len(entries)):
            found = int(entries[at]), total - int(entries[at])
            if self._there(found, held):
                return found
        return None

    def triple(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, int, int] | None:
        """Three available lengths of this sum, besides those that are held."""
        spent = True
        for at in range(self.triple_mark[total], len(self.lengths)):
            first = int(self.lengths[at])
            if first < total and self._there((first,), held):
                rest = self.pair(total - first, (*held, first))
                if rest is not None:
                    return first, *rest
            # only what is gone for good moves the mark: not what is held just now
            gone = first >= total or not self.left[first] or self.pair_mark[total - first] == len(self.pairs[total - first])
            spent = spent and gone
            if spent:
                self.triple_mark[total] = at + 1
        return None

    def fill(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum up to the gap."""
        if self._there((gap,), held):
            return (gap,)
        return self.pair(gap, held) or self.triple(gap, held)


Patterns = list[tuple[tuple[int, ...], int]]


def _take(left: np.ndarray, parts: tuple[int, ...], patterns: Patterns) -> None:
    """Uses a pattern as often as the counts allow."""
    need = Counter(parts)
    n = min(int(left[p]) // m for p, m in need.items())
    for p, m in need.items():
        left[p] -= n * m
    patterns.append((parts, n))


def exact_patterns(left: np.ndarray) -> Patterns:
    """Takes the lengths that fill a sequence exactly, up to four a sequence, out of the counts: from the longest
    length down, its gap is looked up among the sums until it has none any more."""
    capacity, sums, patterns = len(left) - 1, Sums(left), []
    if left[capacity]:
        _take(left, (capacity,), patterns)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := sums.fill(capacity - length, (length,))):
            _take(left, (length, *found), patterns)
    return patterns


def plan_patterns(counts: dict[int, int], capacity: int) -> Patterns:
    """(lengths of one sequence, how many such sequences), from the number of pieces of each length. Every pattern
    uses up some length, so there are at most as many as lengths, for each of the two ways to fill."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns = exact_patterns(left)
    while left.any():  # best fit: always the longest length that the gap still takes
        spare, parts, gap = left.copy(), [], capacity
        while gap and (there := np.flatnonzero(spare[: gap + 1])).size:
            best = int(there[-1])
            times = min(int(spare[best]), gap // best)
            spare[best] -= times
            parts += [best] * times
            gap -= best * times
        _take(left, tuple(parts), patterns)
    return patterns


def pack(
    pieces: DataFrame, *, capacity: int = 2048, buckets: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have doc_id, piece and length (1 to ``capacity``).

    The rows should come from a stored table: they are read for the histogram and again for the places. ``order`` tells
    rows of one length apart, so that a task that is repeated hands out the same places.
    """
    ship_package(pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list[tuple[int, int, int]]] = {length: [] for length in counts}
    used: Counter = Counter()
    sequence = 0
    for parts, n in plan_patterns(counts, capacity):
        offset = 0
        for length in parts:
            by_length[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    # place of a piece: the last entry of its length that begins at or before its rank
    first = {length: np.array([e[0] for e in entries], np.int64) for length, entries in by_length.items()}
    base = {length: np.array([e[1:] for e in entries], np.int64).reshape(-1, 2) for length, entries in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                entry = np.searchsorted(first[length], ranks[own], "right") - 1
                sequences[own] = base[length][entry, 0] + ranks[own] - first[length][entry]
                offsets[own] = base[length][entry, 1]
            columns = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequences), pa.array(offsets)],
                names=[*columns, "sequence_id", "offset"],
            )

    ranked = running_start(
        pieces.withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_bucket", F.pmod("_h", F.lit(buckets))),
        ["length"], "_bucket", ["_h", *order], F.lit(1), "rank",
    ).select(*pieces.columns, "rank")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, with_ids: bool = True, **columns) -> DataFrame:
    """Documents packed whole: one row per piece with its ids (or their CRC-32 instead), sequence and offset."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity, **columns)
    if not with_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    # rows that repeat an id and a piece, with the same ids or others, have a stored number each
    stored = cut(pieces.withColumn("_row", F.monotonically_increasing_id()), "token-pieces")
    return pack(stored, capacity=capacity, order=("doc_id", "piece", "_row")).drop("_row")
