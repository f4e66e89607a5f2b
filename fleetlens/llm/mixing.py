"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal size are dealt to sources by golden-ratio points on the line of cumulative targets, so every
stretch of the mix holds the sources near their weights. A source's documents, shuffled by hash, form a stream
that repeats; its slots, ranked, take consecutive blocks of equal words from that stream.

Defined results: a null text has size 0; a null source is a source of its own and the last; documents of size
0 are never taken; repeated rows are separate documents; a source whose target is below one slot gets one
closing slot of its whole target; an empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import cut, running_start

# The golden ratio's fraction and the range of its multiples, in units of 2 ** -64.
GOLDEN = "11400714819323198485"
TURN = "18446744073709551616"
CELLS = 1024
CHUNK = 65_536


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    words = F.split(text, "[\\x20\\x09-\\x0D]+")
    ends = F.when(F.element_at(words, 1) == "", 1).otherwise(0) + F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    # a blank text splits into two empty ends, an empty one into a single one
    return F.coalesce(F.greatest(F.size(words) - ends, F.lit(0)).cast("long"), F.lit(0))


@dataclass(frozen=True)
class Mix:
    """``documents``: every row with its source's numbers. ``sources``: one row per source. ``pieces``: slot by
    slot, which words of which document the mix takes."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source (key k): size, weight, target. Windows without keys see one row per source only.

    With sources in order of size over weight, those before the first whose cap is above its share are capped;
    the others share what the caps leave.
    """
    sources = sized.groupBy("k").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("k")) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.select(
        "k", "source_size", (rank + 1).cast("long").alias("place"),
        F.element_at(listed, (rank % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(share) * F.sum("source_size").over(Window.partitionBy())).alias("total"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumns(
        {"level": (F.col("total") - before) / rest, "at": F.row_number().over(by_ratio)}
    )
    first = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("at", "level"))).over(
        Window.partitionBy()
    )
    # no level: every source is at its cap
    sources = sources.withColumn(
        "target", F.coalesce(F.least("cap", first["level"] * F.col("weight")), F.col("cap"))
    )
    share_from = F.coalesce(
        F.sum("target").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    ) / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-300))
    return sources.select(
        "k", "place", "source_size", "weight", "target", F.floor("target").alias("goal"),
        share_from.alias("lo"),
    ).withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("k")), F.lit(2.0)))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, k, rank): the slots of the mix in order, and which block of its source each takes."""
    spark = sources.sparkSession
    goal = sources.agg(F.sum("goal")).first()[0] or 0
    n = -(-goal // block_words)
    turn = F.lit(TURN).cast("decimal(20,0)")
    turned = (F.col("id").cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(20,0)")) % turn
    slots = spark.range(n).select(F.col("id").alias("slot"), (turned.cast("double") / float(TURN)).alias("point"))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("point") * CELLS), F.lit(CELLS - 1)))
    cells = sources.where("hi > lo").select(
        "k", "lo", "hi",
        F.explode(F.sequence(
            F.least(F.floor(F.col("lo") * CELLS), F.lit(CELLS - 1)),
            F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    dealt = slots.join(cells, "cell").where("point >= lo and point < hi").select("slot", "k")
    dealt = dealt.join(sources.where("goal >= 1").select("k"), "k", "left_semi")
    closing = (
        sources.where("goal >= 1").join(dealt.select("k").distinct(), "k", "left_anti")
        .select((F.lit(n) + F.col("place")).alias("slot"), "k")
    )
    chunked = dealt.unionByName(closing).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    return running_start(chunked, ["k"], "chunk", ["slot"], F.lit(1), "rank").select("slot", "k", "rank")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block_words: int = 1024, buckets: int = 1024, row_col: str | None = None,
) -> Mix:
    """A mix of ``share`` times all words: sources by code point, null last, weigh ``weights`` in turn; a target
    stops at ``most`` times its source's size and the excess is shared again by weight.

    A source's slots cut its target into blocks of equal words (near ``block_words``), so what is taken of each
    source is its target to the word, and no document is taken more than ``most``, rounded up, times. A number of
    each row in ``row_col`` goes through to ``documents`` and ``taken`` as ``row``: ids may be null or repeat.
    """
    numbers = [F.col(row_col).alias("row")] if row_col else []
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            # null sorts behind every source
            F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")).alias("k"),
            word_count(F.col(text_col)).alias("size"),
            # the same order in any engine
            F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)), 1, 15), 16, 10)
            .cast("long").alias("h"),
            *numbers,
        ),
        "mix-sizes",
    )
    sources = cut(source_targets(sized, weights, share, most), "mix-sources")
    slots = cut(schedule(sources, block_words), "mix-slots")
    counted = slots.groupBy("k").agg(F.count("*").alias("n_slots"))
    sources = sources.join(counted, "k", "left").withColumn(
        "step", F.when(F.col("n_slots") > 0, F.col("goal") / F.col("n_slots"))
    )
    placed = running_start(
        sized.withColumn("bucket", F.pmod("h", F.lit(buckets))), ["k"], "bucket",
        ["h", "doc_id", "size", *(["row"] if row_col else [])], F.col("size"), "place_in_source",
    )
    documents = placed.join(
        sources.select("k", "source_size", "target", "goal", "n_slots", "step"), "k"
    )
    rounds = F.sequence(F.lit(0).cast("long"), F.greatest(
        F.lit(0).cast("long"), F.ceil(F.col("goal") / F.col("source_size")) - 1))
    spans = (
        documents.where("size > 0 and goal > 0")
        .withColumn("round", F.explode(rounds))
        .withColumn("begin", F.col("round") * F.col("source_size") + F.col("place_in_source"))
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal")))
        .where("begin < end")
    )
    near = F.sequence(
        F.greatest(F.lit(0).cast("long"), F.floor(F.col("begin") / F.col("step")) - 1),
        F.least(F.col("n_slots") - 1, F.floor((F.col("end") - 1) / F.col("step")) + 1),
    )
    edge = F.floor(F.col("rank") * F.col("step"))
    next_edge = F.when(F.col("rank") == F.col("n_slots") - 1, F.col("goal")).otherwise(
        F.floor((F.col("rank") + 1) * F.col("step"))
    )
    blocks = (
        spans.withColumn("rank", F.explode(near))
        .withColumn("from", F.greatest(edge, F.col("begin")))
        .withColumn("to", F.least(next_edge, F.col("end")))
        .where("from < to")
        .select(
            "k", "rank", "doc_id", "source", "place_in_source", "round",
            (F.col("from") - F.col("begin")).alias("first_word"), (F.col("to") - F.col("from")).alias("words"),
        )
    )
    return Mix(documents, sources, blocks.join(slots, ["k", "rank"]))


def taken(mixed: Mix) -> DataFrame:
    """Every document with the words that the mix takes of it, repeats counted."""
    per_document = mixed.pieces.groupBy("k", "place_in_source").agg(F.sum("words").alias("taken"))
    names = [c for c in ("row", "doc_id", "source", "size", "source_size", "target") if c in mixed.documents.columns]
    full = mixed.documents.where("size > 0").join(per_document, ["k", "place_in_source"], "left")
    empty = mixed.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.select(*names, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(empty.select(*names, "taken"))
