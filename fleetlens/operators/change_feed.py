"""The change feed: which operations of a poll are news.

A feed remembers one entry per operation name: the status and time of the observation it last cached.
For an observation ``o`` in a poll with cutoff ``L`` (instant of the poll before; NULL: send everything):

* an entry older than 24 hours at the poll, or without a readable time, is forgotten first;
* with no ``L``, ``o`` is news;
* otherwise ``o`` is news if its status differs from the entry's (which is then forgotten), if it is
  RUNNING in any case, or if its start is at least ``L`` + 1 ms;
* news that is not DONE becomes the entry.

The entry after an observation is a function of the entry before it, and such functions compose. So a
name's history need not run through one task: it is cut into segments of ``span`` polls, each segment is
composed on its own, the composed segments are chained to find the entry at the start of each, and every
segment then decides its own rows. Chaining uses the same composition on groups of ``span`` segments, so
no group holds more than ``span`` items as long as a feed spans at most ``span ** 3`` polls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import block
from fleetlens.functions.times import DAY_MS, iso_millis
from fleetlens.operators.sequences import with_previous

ENTRY = "struct<status:string,at:bigint>"


def _no_entry() -> Column:
    return F.lit(None).cast(ENTRY)


def with_cutoff(polls: DataFrame, span: int = 100_000) -> DataFrame:
    """Adds ``cutoff_ms``: the instant of the poll before, from the polls that the table holds."""
    instants = polls.groupBy("poll_id").agg(F.min("poll_ms").alias("poll_ms")).withColumn("_feed", F.lit(0))
    cutoffs = with_previous(instants, ["_feed"], "poll_id", ["poll_ms"], span)
    return polls.join(cutoffs.select("poll_id", F.col("prev_poll_ms").alias("cutoff_ms")), "poll_id")


def observation_facts(polls: DataFrame) -> DataFrame:
    """Adds what the rule needs of each observation.

    ``_at``: the operation's time in milliseconds, its start or else its insertion, NULL if unreadable.
    ``_hit``: whether the row is news whatever the feed remembers.
    """
    start = iso_millis(F.col("start_time"))
    at = F.when(F.length("start_time") > 0, start).otherwise(iso_millis(F.col("insert_time")))
    hit = (
        F.col("cutoff_ms").isNull()
        | (F.upper("status") == "RUNNING")
        | F.coalesce(start >= F.col("cutoff_ms") + 1, F.lit(False))
    )
    return polls.withColumns({"_at": at, "_hit": hit})


def _alive(entry: Column, now: Column) -> Column:
    return F.coalesce(entry["at"] >= now - F.lit(DAY_MS), F.lit(False))


def _step(row: Column) -> Column:
    """An observation as a function on the entry.

    ``none``: result where nothing is cached. ``differ``: result from an entry with another status than
    ``status``. From an entry with that status: itself if ``keeps``, else ``same``. An entry must be alive
    at ``since``, and one with that status up to ``until``; otherwise it counts as nothing cached.
    """
    entry = F.struct(row["status"].alias("status"), row["_at"].alias("at"))
    done = row["status"] == "DONE"
    resets = done | row["_hit"]
    cached = F.when(~done, entry)
    return F.struct(
        F.when(row["_hit"], cached).alias("none"),
        cached.alias("differ"),
        F.when(resets, cached).alias("same"),
        (~resets).alias("keeps"),
        row["status"].alias("status"),
        row["poll_ms"].alias("since"),
        row["poll_ms"].alias("until"),
    )


def _apply(step: Column, entry: Column) -> Column:
    return (
        F.when(~_alive(entry, step["since"]), step["none"])
        .when(entry["status"] != step["status"], step["differ"])
        .when(~_alive(entry, step["until"]), step["none"])
        .when(step["keeps"], entry)
        .otherwise(step["same"])
    )


def _compose(first: Column, then: Column) -> Column:
    """One function for ``first`` followed by ``then``; a NULL function changes nothing."""
    joins = first["status"] == then["status"]
    kept = first["keeps"]
    both = F.struct(
        _apply(then, first["none"]).alias("none"),
        _apply(then, first["differ"]).alias("differ"),
        F.when(~kept, _apply(then, first["same"])).when(joins, then["same"]).otherwise(then["differ"]).alias("same"),
        (kept & joins & then["keeps"]).alias("keeps"),
        first["status"].alias("status"),
        first["since"].alias("since"),
        F.when(~kept, first["until"]).when(joins, then["until"]).otherwise(then["since"]).alias("until"),
    )
    return F.when(first.isNull(), then).when(then.isNull(), first).otherwise(both)


_STEP_TYPE = f"struct<none:{ENTRY},differ:{ENTRY},same:{ENTRY},keeps:boolean,status:string,since:bigint,until:bigint>"


def _compose_all(items: str, add: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, F.lit(None).cast(_STEP_TYPE), add)


def _silent(row: Column) -> Column:
    """Rows the cache is not asked about: DONE in a poll that sends everything."""
    return row["cutoff_ms"].isNull() & (row["status"] == "DONE")


def _place(number: Column, span: int) -> Column:
    """Block of a number, never NULL: Spark then adds no filter on it, and both sides of a join share one shuffle."""
    return F.coalesce(block(number, span), F.lit(0).cast("long"))


def _groups(pieces: DataFrame, span: int, levels: int) -> DataFrame:
    """Pieces (``_name``, ``pos``, ``step``) in order, as ``_name``, ``_group``, ``_pieces``."""
    group = _place(F.col("pos"), span) if levels else F.lit(0).cast("long")
    return pieces.groupBy("_name", group.alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("_pieces")
    )


def _composed_groups(groups: DataFrame) -> DataFrame:
    composed = _compose_all("_pieces", lambda done, p: _compose(done, p["step"])).alias("step")
    return groups.select("_name", F.col("_group").alias("pos"), composed)


# Rows that a walk adds to one array.
_STRETCH = 128


def _walk(items: str, entry: Column, after: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """What ``out`` makes of each entry and item along an array, where ``after`` has the next entry.

    Adding to an array copies it, so rows are added to stretches of bounded length, and those to their list: the copies
    grow with the items and not with their square.
    """
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_STRETCH)), lambda i: i <= F.size(items))
    stretches = F.transform(starts, lambda i: F.slice(items, i, F.lit(_STRETCH)))
    no_rows = F.flatten(F.transform(F.slice(items, 1, 0), lambda item: out(entry, item)))
    no_stretches = F.filter(F.array(no_rows), lambda rows: F.lit(False))

    def add(acc: Column, item: Column) -> Column:
        rows = out(acc["entry"], item)
        return F.struct(after(acc["entry"], item).alias("entry"), F.concat(acc["out"], rows).alias("out"))

    def add_stretch(acc: Column, stretch: Column) -> Column:
        walked = F.aggregate(stretch, F.struct(acc["entry"].alias("entry"), no_rows.alias("out")), add)
        # through an array, so that the stretch is walked once
        return F.transform(F.array(walked), lambda w: F.struct(
            w["entry"].alias("entry"), F.concat(acc["out"], F.array(w["out"])).alias("out")))[0]

    return F.flatten(F.aggregate(stretches, F.struct(entry.alias("entry"), no_stretches.alias("out")), add_stretch)["out"])


def _entries(pieces: DataFrame, span: int, levels: int, entries: DataFrame | None) -> DataFrame:
    """The entry at the start of each piece (``_name``, ``pos``, ``step``), as ``_name``, ``pos``, ``entry``;
    ``entries`` are those at the start of all."""
    groups = _groups(pieces, span, levels)
    if levels == 0:
        if entries is None:
            groups = groups.withColumn("entry", _no_entry())
        else:
            groups = groups.join(entries.select("_name", "entry"), "_name", "left")
    else:
        starts = _entries(_composed_groups(groups), span, levels - 1, entries)
        groups = groups.join(starts.withColumnRenamed("pos", "_group"), ["_name", "_group"], "left")

    def after(entry: Column, piece: Column) -> Column:
        return F.when(piece["step"].isNull(), entry).otherwise(_apply(piece["step"], entry))

    def here(entry: Column, piece: Column) -> Column:
        return F.array(F.struct(piece["pos"].alias("pos"), entry.alias("entry")))

    return groups.select("_name", F.inline(_walk("_pieces", F.col("entry"), after, here)))


def name_key(name: str = "name") -> Column:
    """A name as the key of its history, never NULL: a NULL name has one of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def _segments(polls: DataFrame, span: int) -> DataFrame:
    observed = observation_facts(polls)
    row = F.struct("poll_id", *(c for c in observed.columns if c != "poll_id"))
    return observed.groupBy(name_key().alias("_name"), _place(F.col("poll_id"), span).alias("pos")).agg(
        F.array_sort(F.collect_list(row)).alias("_rows")
    )


def _pieces(segments: DataFrame) -> DataFrame:
    composed = _compose_all("_rows", lambda done, r: F.when(_silent(r), done).otherwise(_compose(done, _step(r))))
    return segments.select("_name", "pos", composed.alias("step"))


def feed_entries(polls: DataFrame, entries: DataFrame | None = None, span: int = 512) -> DataFrame:
    """``_name`` (see ``name_key``) and ``entry``: what a feed remembers after these polls of each name in them.

    ``entries`` has what it remembers before, one row per name at most. Rows of a name are composed to one step per
    segment before they meet, so no task holds a name's rows.
    """
    pieces = _pieces(_segments(polls, span))
    whole = _composed_groups(_groups(_composed_groups(_groups(pieces, span, 1)), span, 0))
    if entries is None:
        known = whole.withColumn("entry", _no_entry())
    else:
        known = whole.join(entries.select("_name", "entry"), "_name", "left")
    after = F.when(F.col("step").isNull(), F.col("entry")).otherwise(_apply(F.col("step"), F.col("entry")))
    return known.select("_name", after.alias("entry"))


def operation_delta(polls: DataFrame, span: int = 512, entries: DataFrame | None = None) -> DataFrame:
    """The observations that are news, over a whole table of polls.

    ``polls``: ``poll_id`` (whole number, rising with time), ``poll_ms``, ``cutoff_ms`` (see
    ``with_cutoff``), ``name`` (once per poll), ``status``, ``start_time``, ``insert_time`` (ISO 8601), and
    any more columns of types that can be ordered, which come out unchanged. ``entries``: what the feed remembers
    from before, as ``feed_entries`` gives it.
    """
    segments = _segments(polls, span)
    # both sides of the join read one and the same shuffle of the observations
    started = segments.join(_entries(_pieces(segments), span, 1, entries), ["_name", "pos"], "left")

    def after(entry: Column, r: Column) -> Column:
        return F.when(_silent(r), entry).otherwise(_apply(_step(r), entry))

    def news(entry: Column, r: Column) -> Column:
        changed = _alive(entry, r["poll_ms"]) & (entry["status"] != r["status"])
        return F.filter(F.array(r), lambda _: r["_hit"] | F.coalesce(changed, F.lit(False)))

    return started.select(F.inline(_walk("_rows", F.col("entry"), after, news))).select(*polls.columns)
