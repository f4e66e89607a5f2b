"""Operation views and the change feed."""

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.times import DAY_MS, iso_millis, wall_millis
from fleetlens.operators import change_feed
from fleetlens.operators.change_feed import operation_delta, with_cutoff
from fleetlens.operators.operations import (
    latest_operation,
    operation_view,
    recent_operations,
    status_changes,
    status_label,
)
from fleetlens.operators.sequences import with_previous
from fleetlens.session import scratch_folder
from fleetlens.streaming.partials import Partials, added, newest
from fleetlens.streaming.operations import feed_memory, read_feed, read_polls, start_operation_feed

T0 = 1_700_000_000_000
POLLS = "poll_id long, poll_ms long, name string, status string, start_time string, insert_time string"


def iso(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def at(poll):
    return T0 + 4000 * poll


def feed_rule(rows):
    """The rule row by row: ``rows`` of (poll_id, poll_ms, cutoff_ms, name, status, start_ms or text, insert_ms)."""
    cache, news = {}, []
    for poll, now, cutoff, name, status, begun, insert in sorted(rows, key=lambda r: r[0]):
        held = cache.get(name)
        if held and (held[1] is None or held[1] < now - DAY_MS):
            cache.pop(name)
        emitted = True
        if cutoff is not None:
            changed = name in cache and cache[name][0] != status
            if changed:
                cache.pop(name)
            fresh = isinstance(begun, int) and begun >= cutoff + 1
            emitted = changed or status.upper() == "RUNNING" or fresh
        if emitted:
            news.append((poll, name))
            if status != "DONE":
                time = insert if begun in (None, "") else begun
                cache[name] = (status, time if isinstance(time, int) else None)
    return sorted(news)


def text(ms):
    return iso(ms) if isinstance(ms, int) else ms


def test_feed_cases(spark):
    rows = [  # poll, name, status, start, emitted
        (1, "a", "PENDING", None, True),
        (1, "d", "DONE", at(0), True),
        (2, "a", "PENDING", None, False),
        (2, "b", "PENDING", None, False),
        (2, "c", "running", at(0), True),
        (2, "d", "DONE", at(0), False),
        (3, "a", "RUNNING", at(2) + 5, True),
        (3, "b", "DONE", at(2) - 5, False),
        (3, "e", "DONE", at(2), False),
        (3, "f", "DONE", at(2) + 1, True),
        (3, "g", "DONE", "yesterday", False),
        (4, "a", "DONE", at(3) - 5, True),
        (5, "a", "DONE", at(3) - 5, False),
    ]
    polls = spark.createDataFrame([(p, at(p), n, s, text(b), iso(at(0))) for p, n, s, b, _ in rows], POLLS)
    want = sorted((p, n) for p, n, _, _, emitted in rows if emitted)
    for span in (1, 2, 512):
        got = operation_delta(with_cutoff(polls, span=2), span=span).collect()
        assert sorted((r.poll_id, r.name) for r in got) == want


@pytest.mark.parametrize(
    "begun, insert, forgotten",
    [
        (at(2) - DAY_MS - 1000, at(1), True),
        (at(2) - DAY_MS, at(2) - 2 * DAY_MS, False),
        (None, at(2) - DAY_MS - 1, True),
        ("", at(1), False),
        ("broken", at(1), True),
    ],
)
def test_entry_expires_by_operation_time(spark, begun, insert, forgotten):
    rows = [
        (1, at(1), "x", "PENDING", text(begun), iso(insert)),
        (2, at(2), "x", "OTHER", None, iso(insert)),
    ]
    got = operation_delta(with_cutoff(spark.createDataFrame(rows, POLLS))).collect()
    assert [r.poll_id for r in got] == ([1] if forgotten else [1, 2])


def random_feed(seed, names=6, polls=40):
    rng = random.Random(seed)
    hour = 3_600_000
    rows = []
    for poll in range(polls):
        now = T0 + poll * 5 * hour
        cutoff = None if poll == 0 or rng.random() < 0.08 else now - 5 * hour
        for n in range(names):
            if rng.random() < 0.75:
                status = rng.choice(["PENDING", "QUEUED", "DONE", "RUNNING", "running", "PENDING", "QUEUED"])
                age = rng.choice([0, 2, 6, 20, 23, 25, 40]) * hour
                begun = rng.choice([None, "", "n/a", now - age, now - age])
                insert = rng.choice([now - 20 * hour, now - 30 * hour, "n/a"])
                rows.append((poll, now, cutoff, f"op{n}", status, begun, insert))
    return rows


def as_frame(spark, rows):
    schema = "poll_id long, poll_ms long, cutoff_ms long, name string, status string, start_time string, insert_time string"
    return spark.createDataFrame([(p, t, c, n, s, text(b), text(i)) for p, t, c, n, s, b, i in rows], schema)


@pytest.mark.parametrize("seed, span", [(1, 1), (2, 2), (3, 3), (4, 7), (5, 512)])
def test_feed_equals_the_rule_on_random_polls(spark, seed, span):
    rows = [r for k in range(6) for r in ((*x[:3], f"{k}-{x[3]}", *x[4:]) for x in random_feed(10 * seed + k))]
    got = operation_delta(as_frame(spark, rows), span=span).collect()
    assert sorted((r.poll_id, r.name) for r in got) == feed_rule(rows)


def test_feed_keeps_other_columns(spark):
    rows = as_frame(spark, random_feed(99)).withColumn("user", F.concat(F.lit("u"), "poll_id"))
    got = operation_delta(rows)
    assert got.columns == rows.columns and got.filter("user <> concat('u', poll_id)").count() == 0


def test_stream_of_polls_equals_batch(spark):
    """Ten files, one per batch, in time order: state lives on between batches."""
    rows = random_feed(42, names=8, polls=60)
    folder, out = scratch_folder(spark, "polls"), scratch_folder(spark, "news")
    schema = as_frame(spark, rows[:1]).schema
    for k in range(10):
        part = [r for r in rows if r[0] // 6 == k]
        as_frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    memory = scratch_folder(spark, "memory")
    query = start_operation_feed(arriving, out, memory, scratch_folder(spark, "state"), span=3, compact_every=3)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 10
    got = read_feed(spark, out, schema)
    assert sorted((r.poll_id, r.name) for r in got.collect()) == feed_rule(rows)
    want = operation_delta(as_frame(spark, rows), span=4)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_polls_come_out_whole_and_unchanged(spark):
    """A file that arrives hours late loses no row, and microseconds survive."""
    rows = [(10, 10, "a", 0), (20, 20, "b", 0), (1, 1, "c", 0)]
    folder, out = scratch_folder(spark, "polls"), scratch_folder(spark, "news")
    for poll, hours, name, _ in rows:
        one = spark.createDataFrame(
            [(poll, hours * 3_600_000, None, name, "RUNNING", None, None)],
            "poll_id long, poll_ms long, cutoff_ms long, name string, status string, start_time string, insert_time string",
        ).withColumns({"seen": F.lit("2024-01-01 00:00:00.123456").cast("timestamp"),
                       "local": F.lit("2024-01-01 00:00:00.654321").cast("timestamp_ntz")})
        one.coalesce(1).write.mode("append").parquet(folder)
    arriving, memory = read_polls(spark, folder, one.schema, 1), scratch_folder(spark, "memory")
    start_operation_feed(arriving, out, memory, scratch_folder(spark, "state")).awaitTermination()
    got = read_feed(spark, out, one.schema)
    assert sorted(r.poll_id for r in got.collect()) == [1, 10, 20]
    assert got.filter("date_format(seen, 'SSSSSS') = '123456' and cast(local as string) like '%.654321'").count() == 3


POLL_SCHEMA = "poll_id long, poll_ms long, cutoff_ms long, name string, status string, start_time string, insert_time string"
HOUR = 3_600_000


def test_hot_name_in_a_stream_is_spread_over_its_segments(spark):
    """A third of a batch under one name: as the rule has it, and no task reads more than a few segments of it."""
    folder, out = scratch_folder(spark, "polls"), scratch_folder(spark, "news")
    states = ["PENDING", "QUEUED", "RUNNING", "PENDING", "DONE", "QUEUED"]
    rows = [(k, k * HOUR, k * HOUR - HOUR if k else None, "hot", states[k % 7 % 6], None, text(k * HOUR - HOUR)) for k in range(6000)]
    rows += [(k, k * HOUR, k * HOUR - HOUR if k else None, f"n{k % 300}-{j}", states[(k // 300 + j) % 6], None, text(k * HOUR - HOUR))
             for k in range(6000) for j in range(2)]
    for half in (0, 1):
        part = spark.createDataFrame([r for r in rows if r[0] // 3000 == half], POLL_SCHEMA)
        part.repartition(4).write.mode("append").parquet(folder)
    arriving = read_polls(spark, folder, POLL_SCHEMA, 4)
    start_operation_feed(arriving, out, scratch_folder(spark, "memory"), scratch_folder(spark, "state"), span=64).awaitTermination()
    got = sorted((r.poll_id, r.name) for r in read_feed(spark, out, POLL_SCHEMA).collect())
    plain = [(p, t, c, n, s, None, None if i is None else p * HOUR - HOUR) for p, t, c, n, s, _, i in rows]
    assert got == feed_rule(plain) and 3000 < len(got) < 18000
    # what a name's rows meet in: a list per segment
    segments = change_feed._segments(spark.createDataFrame(rows, POLL_SCHEMA), 64)
    assert segments.selectExpr("max(size(_rows))").first()[0] == 64


def test_entries_after_polls_are_those_of_the_rule(spark):
    """The feed in two parts, the second from the entries after the first, gives what it gives whole."""
    rows = random_feed(77, names=9, polls=50)
    first, second = ([r for r in rows if (r[0] < 25) == early] for early in (True, False))
    memory = change_feed.feed_entries(as_frame(spark, first), span=3)
    assert memory.count() == len({r[3] for r in first})
    got = operation_delta(as_frame(spark, first), span=3).union(operation_delta(as_frame(spark, second), 5, memory))
    assert sorted((r.poll_id, r.name) for r in got.collect()) == feed_rule(rows)
    again = change_feed.feed_entries(as_frame(spark, second), memory, span=2)
    whole = change_feed.feed_entries(as_frame(spark, rows), span=512)
    seen = again.select("_name")
    assert again.exceptAll(whole.join(seen, "_name", "left_semi")).count() == 0


def test_idle_names_are_forgotten_and_no_late_poll_is_lost(spark):
    folder, out, memory, state = (scratch_folder(spark, p) for p in ("polls", "news", "memory", "state"))
    day = 24 * HOUR

    def arrive(now, *polls):
        rows = [(p, p * HOUR, p * HOUR - HOUR, name, "PENDING", None, text(p * HOUR - HOUR)) for p, name in polls]
        spark.createDataFrame(rows, POLL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        arriving = read_polls(spark, folder, POLL_SCHEMA)
        start_operation_feed(arriving, out, memory, state, clock=lambda: now / 1000, compact_every=1).awaitTermination()
        return {r["_name"] for r in feed_memory(spark, memory).collect()}

    assert arrive(0, (100, "a"), (100, "b")) == {"=a", "=b"}
    assert arrive(day // 2, (112, "b"), (112, "c")) == {"=a", "=b", "=c"}
    # a has been idle for over a day, b and c have not
    assert arrive(day + HOUR, (125, "d")) == {"=b", "=c", "=d"}
    # late by days: decided and stored like any other
    assert arrive(day + 2 * HOUR, (3, "a"), (4, "e")) == {"=a", "=b", "=c", "=d", "=e"}
    # after a long silence nothing is left but what has just come
    assert arrive(9 * day, (300, "f")) == {"=f"}
    news = {(r.poll_id, r.name) for r in read_feed(spark, out, POLL_SCHEMA).collect()}
    quiet = {(100, "a"), (100, "b"), (112, "b"), (112, "c"), (125, "d"), (3, "a"), (4, "e"), (300, "f")}
    # none of these is a hit or a change, so none is news; RUNNING ones would be, however late
    assert news == set()
    spark.createDataFrame([(p, p * HOUR, p * HOUR - HOUR, n, "RUNNING", None, None) for p, n in quiet], POLL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    start_operation_feed(read_polls(spark, folder, POLL_SCHEMA), out, memory, state, clock=lambda: 9 * day / 1000).awaitTermination()
    assert {(r.poll_id, r.name) for r in read_feed(spark, out, POLL_SCHEMA).collect()} == quiet


def test_a_batch_that_is_repeated_replaces_itself(spark):
    """Partial tables after compactions, repeated batches and half-written folders."""
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, at int, v long")
    sums = Partials(spark, scratch_folder(spark, "sums"), "k string, v long", added(["k"]), compact_every=2)
    last = Partials(spark, scratch_folder(spark, "last"), rows.schema, newest(["k"], ["at"]), compact_every=2)
    assert sums.read().collect() == [] and sums.read().columns == ["k", "v"]
    for number in (0, 1, 1, 2, 2, 3, 4, 4, 5):
        sums.put(rows.select("k", "v"), number)
        last.put(rows.withColumn("v", F.col("v") + number), number)
    assert dict(map(tuple, sums.read().collect())) == {"a": 180, "b": 30}
    assert dict(map(tuple, sums.read(before=5).collect())) == {"a": 150, "b": 25}
    assert {(r.k, r.at) for r in last.read().collect()} == {("a", 2), ("b", 1)}
    # half-written: no _SUCCESS
    os.makedirs(f"{sums.path}/batch=6")
    os.makedirs(f"{sums.path}/base=6")
    assert dict(map(tuple, sums.read().collect())) == {"a": 180, "b": 30}
    assert len(sums._stored("base")) == 2 and len(sums._stored("batch")) < 6


def test_null_and_empty_names_have_their_own_history(spark):
    schema = "poll_id long, poll_ms long, cutoff_ms long, name string, status string, start_time string, insert_time string"
    iso = "1970-01-01T00:00:00.000Z"
    rows = [(1, 1000, None, None, "PENDING", None, iso), (2, 2000, 1000, "", "QUEUED", None, iso)]
    assert [r.poll_id for r in operation_delta(spark.createDataFrame(rows, schema)).collect()] == [1]


def test_many_recent_operations_take_the_same_plan(spark):
    rows = spark.range(6000).selectExpr("id", "id % 2 as kind")
    for n in (3, 2500):
        got = recent_operations(rows, ["id"], n, by="kind").collect()
        assert sorted((r.kind, r.position, r.id) for r in got) == [(k, p, 6000 + k - 2 * p) for k in (0, 1) for p in range(1, n + 1)]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_previous_value_crosses_segments(spark, span):
    rng = random.Random(span)
    rows = [(k, i, rng.choice(["a", "b", None])) for k in ("hot", "cold") for i in range(60) if k == "hot" or i % 9 == 4]
    got = with_previous(spark.createDataFrame(rows, "k string, i long, v string"), ["k"], "i", ["v"], span).collect()
    last, want = {}, []
    for k, i, v in rows:
        want.append((k, i, v, last.get(k)))
        last[k] = v
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_status_changes_need_an_open_status_before(spark):
    rows = [("a", 1, "PENDING"), ("a", 2, "RUNNING"), ("a", 3, "RUNNING"), ("a", 4, "DONE"), ("a", 5, "PENDING"), ("b", 2, "DONE")]
    events = spark.createDataFrame(rows, "name string, i long, status string")
    got = status_changes(events, "i", span=2).collect()
    assert sorted((r.name, r.i, r.prev_status) for r in got) == [("a", 2, "PENDING"), ("a", 4, "RUNNING")]


def test_operation_view_takes_the_last_part_of_the_link(spark):
    schema = "name string, insert_time string, start_time string, end_time string, progress int, status string, user string, optype string, target_link string"
    rows = [("a", "t", None, None, 5, "DONE", "u", "insert", link) for link in ("https://c/zones/z", "plain", "ends/", None)]
    got = [r.target for r in operation_view(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["z", "plain", "", None]


def test_labels(spark):
    rows = [("DONE",), ("RUNNING",), ("PENDING",), ("done",), ("ODD",)]
    got = status_label(spark.createDataFrame(rows, "status string")).collect()
    assert [tuple(r) for r in got] == [
        ("DONE", "done", "success"),
        ("RUNNING", "running", "info"),
        ("PENDING", "pending", "warning"),
        ("done", "done", "important"),
        ("ODD", "ODD", "important"),
    ]


def test_latest_and_recent(spark):
    rows = [(f"op{i % 4}", i, f"z{i % 3}") for i in range(200)]
    ops = spark.createDataFrame(rows, "name string, i long, zone string").repartition(5)
    assert sorted((r.name, r.i) for r in latest_operation(ops, ["i"]).collect()) == [(f"op{k}", 196 + k) for k in range(4)]
    assert [r.i for r in recent_operations(ops, ["i"]).collect()] == list(range(199, 149, -1))
    by_zone = recent_operations(ops, ["i"], n=2, by="zone").orderBy("zone", "position").collect()
    assert [(r.zone, r.i) for r in by_zone] == [("z0", 198), ("z0", 195), ("z1", 199), ("z1", 196), ("z2", 197), ("z2", 194)]


def test_long_top_lists_are_cut_in_slices_first(spark):
    ops = spark.range(40000).select(F.col("id").alias("i"), F.when(F.col("id") < 39000, "hot").otherwise("cold").alias("zone"))
    got = recent_operations(ops, ["i"], n=2500, by="zone")
    assert "_slice" in got._jdf.queryExecution().analyzed().toString()
    rows = got.groupBy("zone").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("position").alias("last")).collect()
    assert sorted(map(tuple, rows)) == [("cold", 1000, 39000, 1000), ("hot", 2500, 36500, 2500)]


def test_a_top_list_limits_rows_before_the_shuffle(spark):
    ops = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 3).alias("zone"))
    plan = recent_operations(ops, ["i"], by="zone")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Exchange")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-07-01T00:00:00.179Z", "2024-07-01T05:30:00.179+05:30", "2024-06-30T17:00:00.179-07", "2024-07-01", "x", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        want = 1719792000179
        assert [r[0] for r in df.select(iso_millis(F.col("t"))).collect()] == [want] * 3 + [None] * 3
        wall = spark.sql("select timestamp_ntz'2024-07-01 00:00:00.179999' as ts").select(wall_millis(F.col("ts"))).first()[0]
        assert wall == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
