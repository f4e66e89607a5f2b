"""One inventory listing of any size, read by many tasks.

A listing is one JSON object, ``{"<kind>": {"<id>": {...}, ...}}``. Where a block of its bytes begins, a reader does not
know whether it is within a string or how deep. But a block can be summed up without knowing: for each of three states
that it may begin in (outside a string, inside, inside after a backslash) it has a state that it ends in and a change of
depth. The sums of a file's blocks are chained, one small row per block; then every block knows where it stands, finds the
entries that begin in it, and reads on to the end of its last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.files import listed_files, opened
from fleetlens.sources.inventory import LISTING_OBJECTS
from fleetlens.session import ship_package

# Bytes of a block.
BLOCK_BYTES = 1 << 20
OUTSIDE, INSIDE, ESCAPED = range(3)
_QUOTE, _BACKSLASH = 0x22, 0x5C
# How much each byte changes the depth outside of strings.
_STEP = np.zeros(256, np.int64)
_STEP[[0x7B, 0x5B]] = 1
_STEP[[0x7D, 0x5D]] = -1


def scan(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a run of bytes that begins in a state: the places of the quotes that open or close strings, the depth after
    each byte as counted from 0, and the state at the end."""
    data = np.frombuffer(raw, np.uint8)
    places = np.arange(len(data))
    # backslashes in a row before each byte, one more at the start after a backslash
    other = np.where(data != _BACKSLASH, places, -1)
    last = np.concatenate([[-1], np.maximum.accumulate(other)[:-1]]) if len(data) else other
    before = places - 1 - last + ((last < 0) & (state == ESCAPED))
    quotes = np.flatnonzero((data == _QUOTE) & (before % 2 == 0))
    flips = np.zeros(len(data), np.int64)
    flips[quotes] = 1
    inside = (np.cumsum(flips) + (state != OUTSIDE)) % 2 == 1
    # a bracket counts outside; that a quote is inside or not does not matter to it
    depth = np.cumsum(np.where(inside, 0, _STEP[data]))
    if not len(data):
        return quotes, depth, state
    end = OUTSIDE
    if inside[-1]:
        slashes = int(before[-1]) + 1 if data[-1] == _BACKSLASH else 0
        end = ESCAPED if slashes % 2 else INSIDE
    return quotes, depth, end


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ends, deltas) of each block, by the state that it begins in."""
    for batch in batches:
        ends, deltas = [], []
        for path, begin, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "size"))):
            raw = _read(path, begin, size)
            found = [scan(raw, state) for state in (OUTSIDE, INSIDE, ESCAPED)]
            ends.append([f[2] for f in found])
            deltas.append([int(f[1][-1]) if len(f[1]) else 0 for f in found])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(deltas, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "ends", "deltas"])


def _chained(blocks: pa.Table) -> pa.Table:
    """The state and depth at which each block of a file begins."""
    blocks = blocks.sort_by("begin")
    state, depth, states, depths = OUTSIDE, 0, [], []
    for ends, deltas in zip(blocks.column("ends").to_pylist(), blocks.column("deltas").to_pylist()):
        states.append(state), depths.append(depth)
        depth, state = depth + deltas[state], ends[state]
    return pa.table({
        **{c: blocks.column(c) for c in ("path", "begin", "size", "length")},
        "state": pa.array(states, pa.int32()), "depth": pa.array(depths, pa.int64()),
    })


def _read(path: str, begin: int, size: int) -> bytes:
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        file.seek(begin)
        return file.read(size)


def _entries_of(path: str, begin: int, size: int, length: int, state: int, depth: int) -> Iterator[str]:
    """The entries (``"id": {...}``) whose key begins in the block: strings that open at depth 2."""
    raw, ahead = _read(path, begin, size), min(size, 1 << 16)
    own = len(raw)
    while True:
        quotes, change, end = scan(raw, state)
        after = depth + change
        opens = quotes[0 if state == OUTSIDE else 1 :: 2]
        starts = opens[after[opens] == 2]
        # what ends an entry: the next key, or the end of the listing
        closes = np.flatnonzero((after == 1) & (np.concatenate([[depth], after[:-1]]) == 2)) if len(after) else starts
        mine = starts[starts < own]
        marks = np.sort(np.concatenate([starts, closes]))
        if not len(mine) or marks[-1] > mine[-1] or begin + len(raw) >= length:
            break
        raw += _read(path, begin + len(raw), ahead)
        ahead *= 2
    for start in mine:
        later = marks[marks > start] if len(mine) < 64 else marks[np.searchsorted(marks, start, "right") :]
        stop = int(later[0]) if len(later) else len(raw)
        yield raw[start:stop].decode("utf-8").rstrip().rstrip(",").rstrip()


def _taken_apart(kind: str):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("path", "begin", "size", "length", "state", "depth")
            for block in zip(*(batch.column(c).to_pylist() for c in names)):
                ids, objects = [], []
                for entry in _entries_of(*block):
                    key, at = json.JSONDecoder().raw_decode(entry)
                    ids.append(key), objects.append(entry[at:].lstrip().removeprefix(":"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(objects, pa.string())], names=["id", "object"])

    return entries


def read_large_inventory(spark: SparkSession, path: str, kind: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``read_inventory`` of files that hold one listing each, of one kind and of any size: ``id`` and its fields.

    A task holds one block and the rest of its last entry. The values of a listing are objects. Bytes are read twice.
    """
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.least(F.lit(block_bytes), F.col("length") - F.col("begin"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    blocks = listed_files(spark, path).select("path", "length", F.explode(begins).alias("begin")).withColumn("size", size)
    columns = "path string, length bigint, begin bigint, size bigint"
    summed = blocks.repartition(n, "path", "begin").mapInArrow(_summed, f"{columns}, ends array<int>, deltas array<bigint>")
    placed = summed.groupBy("path").applyInArrow(
        _chained, "path string, begin bigint, size bigint, length bigint, state int, depth bigint")
    found = placed.repartition(n, "path", "begin").mapInArrow(_taken_apart(kind), "id string, object string")
    return found.select("id", F.from_json("object", LISTING_OBJECTS[kind]).alias("_o")).select("id", "_o.*")
