"""Large listings: blocks whose beginnings are within strings, escapes and objects."""

import json
import random

import pytest

from fleetlens.sources import listing_blocks
from fleetlens.sources.inventory import read_inventory


def value(draw, depth):
    kind = draw.random()
    if depth > 3 or kind < 0.4:
        return draw.choice(['a"b', "\\", '\\\\"', "{", "}],", "é\n", 1, None, True, 'x,"y":{'])
    if kind < 0.7:
        return {draw.choice(['k"', "{", "n", "\\"]) + str(n): value(draw, depth + 1) for n in range(draw.randrange(4))}
    return [value(draw, depth + 1) for _ in range(draw.randrange(4))]


@pytest.mark.parametrize("seed", range(12))
def test_entries_of_any_blocks(tmp_path, seed):
    """Whatever the size of blocks, each entry is found once, by the block that its key begins in."""
    draw = random.Random(seed)
    for size in (1, 2, 3, 17, 100, 10**6):
        ids = [draw.choice(["a", 'q"', "b\\", "{", "é", ""]) + str(n) for n in range(draw.randrange(9))]
        objects = {i: {"v": value(draw, 1)} for i in ids}
        raw = json.dumps({"disks": objects}, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])).encode()
        path = str(tmp_path / "listing.json")
        (tmp_path / "listing.json").write_bytes(raw)
        state, depth, got = listing_blocks.OUTSIDE, 0, []
        for begin in range(0, len(raw), size):
            part = raw[begin : begin + size]
            for entry in listing_blocks._entries_of(path, begin, len(part), len(raw), state, depth):
                key, at = json.JSONDecoder().raw_decode(entry)
                got.append((key, json.loads(entry[at:].lstrip().removeprefix(":"))))
            change, state = listing_blocks.scan(part, state)[1:]
            depth += int(change[-1])
        assert got == list(objects.items()) and (state, depth) == (listing_blocks.OUTSIDE, 0)


def test_one_listing_is_read_by_many_tasks(spark, tmp_path):
    """A listing in one line, and others in several: as the reader of whole listings has them."""
    draw = random.Random(1)
    listings = []
    for n in range(3):
        count = (20_000, 0, 50)[n]
        listings.append({"zones": {f'z{n}-{k}"' * draw.randint(1, 3): {"name": f"n{k}{{", "status": None, "region": "r\\"} for k in range(count)}})
        (tmp_path / f"{n}.json").write_text(json.dumps(listings[-1], indent=2 if n else None))
    whole = read_inventory(spark, str(tmp_path), "zones", multi_line=True)
    got = listing_blocks.read_large_inventory(spark, str(tmp_path), "zones", block_bytes=10_000)
    assert got.columns == whole.columns and got.count() == whole.count() == sum(len(x["zones"]) for x in listings)
    assert got.exceptAll(whole).count() == 0
