import itertools
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import packing, tokenizing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, capacity=2048):
    library = tokenizing.load(PATH)
    out = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            out[doc_id, at // capacity, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    return out


def check_places(rows, capacity=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_tricky_documents(tricky_docs, tricky):
    rows = packing.pack_documents(tricky_docs, PATH, with_ids=False).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == expected([(i, t) for i, t, _ in tricky])
    n = check_places(rows)
    assert n == -(-sum(r["length"] for r in rows) // 2048)


def test_ids_come_whole(tricky_docs, tricky):
    rows = packing.pack_documents(tricky_docs, PATH, capacity=50).where("doc_id = 8").collect()
    ids = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["piece"]))
    text = next(t for i, t, _ in tricky if i == 8)
    want = tokenizing.load(PATH).encode(text, add_special_tokens=False).ids + [0]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1))
def test_patterns_use_every_piece_once(counts):
    patterns = packing.plan_patterns(counts, 40)
    used = Counter()
    for parts, n in patterns:
        assert n > 0 and sum(parts) <= 40
        for p in parts:
            used[p] += n
    assert used == Counter(counts)
    total = sum(a * b for a, b in counts.items())
    # no two sequences that are half empty: at most twice the least
    assert sum(n for _, n in patterns) <= 2 * -(-total // 40)


@pytest.mark.parametrize("counts, n", [
    ({30: 1, 10: 1}, 1), ({20: 1, 13: 1, 7: 1}, 1), ({10: 4}, 1), ({25: 1, 6: 1, 5: 1, 4: 1}, 1),
    ({21: 3, 19: 3}, 3), ({40: 2, 39: 1, 1: 1}, 3), ({}, 0),
])
def test_exact_sums_are_found(counts, n):
    assert sum(times for _, times in packing.plan_patterns(counts, 40)) == n


def sums_of(left, total):
    """All ways to add up to ``total`` by one, two or three available lengths, by trying them."""
    there = [n for n in range(1, total + 1) if left[n]]
    for size in (1, 2, 3):
        for parts in itertools.combinations_with_replacement(there, size):
            if sum(parts) == total and all(left[p] >= n for p, n in Counter(parts).items()):
                yield parts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 4), min_size=1), st.data())
def test_index_of_sums_against_trying_all(counts, data):
    """Also after counts have run out, and besides a length that is held."""
    left = np.zeros(25, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums = packing.Sums(left)
    for _ in range(12):
        total = data.draw(st.integers(1, 24))
        held = data.draw(st.sampled_from(sorted(counts)))
        if not left[held]:
            continue
        without = left.copy()
        without[held] -= 1
        found, ways = sums.fill(total, (held,)), set(sums_of(without, total))
        assert (found is None) == (not ways)
        if found:
            assert tuple(sorted(found)) in ways and len(found) == min(map(len, ways))
            for p in found:
                left[p] -= 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1))
def test_every_gap_with_an_exact_sum_is_filled_so(counts):
    left = np.zeros(31, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = packing.exact_patterns(left)
    assert all(sum(parts) == 30 and len(parts) <= 4 and n > 0 for parts, n in patterns)
    for length in np.flatnonzero(left):
        without = left.copy()
        without[length] -= 1
        assert not list(sums_of(without, 30 - length))


def test_repeated_rows_of_one_id_have_places_of_their_own(spark):
    rows = [(1, "one two three")] * 30 + [(1, "uno dos tres")] * 30 + [(None, "one two three")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    packed = packing.pack_documents(docs, PATH, capacity=64, with_ids=False).collect()
    check_places(packed, 64)
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(rows)


def test_sequences_of_a_table(spark):
    """As few as there can be, but for one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    packed = packing.pack_documents(docs, PATH, with_ids=False).selectExpr("sum(length) AS ids", "count(distinct sequence_id) AS n").first()
    assert packed["n"] <= -(-packed["ids"] // 2048) + 1
