"""Load-test telemetry: lines to measures, series, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from fleetlens.functions.measures import OP_CODES, measure_format
from fleetlens.functions.numbers import block

# Column prefix of each operation type in the wide form, in message order.
WIDE_PREFIX = {"INSERT": "insert", "UPDATE": "update", "DELETE": "delete", "SCAN": "scan", "READ": "read"}

_MEASURE_FIELDS = ("time", "op", "ops", "avg_latency")

# The columns that order the lines of a node as they arrived; lines may have only some of them.
ARRIVAL = ("file_time", "file", "split", "seq", "piece")
# Those that a part of a node's lines lies within.
_SOURCE = ("file_time", "file", "split")


def arrival(lines: DataFrame) -> list[str]:
    """The columns that order the lines of a node."""
    return [c for c in ARRIVAL if c in lines.columns]


def _with_measure(lines: DataFrame, fmt: str) -> DataFrame:
    """Adds the measure's fields; ``op`` is NULL on a line that is no measure.

    Taking the fields out through a generator keeps filters on them behind it. As plain columns, Spark would
    move such a filter before the format and evaluate the format twice.
    """
    parsed = lines.withColumn("_measure", measure_format(fmt)(F.col("line")))
    return parsed.select(*lines.columns, F.inline(F.array("_measure")))


def parse_measures(lines: DataFrame, fmt: str = "bracketed") -> DataFrame:
    """Lines that are measures, typed; other lines are left out. No shuffle."""
    return _with_measure(lines, fmt).filter(F.col("op").isNotNull()).drop("line")


def split_rejects(
    lines: DataFrame, failures: DataFrame | None = None, fmt: str = "bracketed"
) -> tuple[DataFrame, DataFrame]:
    """Measures and error text; every line is in exactly one of the two.

    ``failures`` (``node``, ``failed_from``: one row per failed node) turns all lines of a node from that point on
    into error text, whatever they hold, in all files that come later. ``failed_from`` is a struct of the lines'
    ``arrival`` columns, or a plain ``seq`` where lines have no other of them.
    """
    parsed = _with_measure(lines, fmt)
    measure = F.col("op").isNotNull()
    if failures is not None:
        order = arrival(lines)
        plain = not isinstance(failures.schema["failed_from"].dataType, StructType)
        if plain and order != ["seq"]:
            raise ValueError(f"failed_from must be a struct of {', '.join(order)}")
        here = F.col("seq") if plain else F.struct(*order)
        parsed = parsed.join(failures.select("node", "failed_from"), "node", "left")
        measure = measure & ~F.coalesce(here >= F.col("failed_from"), F.lit(False))
    return (
        parsed.filter(measure).select(*(c for c in lines.columns if c != "line"), *_MEASURE_FIELDS),
        parsed.filter(~measure).select(*lines.columns),
    )


def with_op_code(measures: DataFrame) -> DataFrame:
    """Adds ``op_code``, the number of the operation type."""
    codes = [F.lit(x) for pair in OP_CODES.items() for x in pair]
    return measures.withColumn("op_code", F.try_element_at(F.create_map(*codes), F.col("op")))


def measure_wide(measures: DataFrame) -> DataFrame:
    """One row per measure with a count and a mean for each operation type; 0 where it has none."""
    kept = [c for c in measures.columns if c not in ("op", "ops", "avg_latency")]

    def only(op: str, value: str, zero: Column) -> Column:
        return F.when(F.col("op") == op, F.col(value)).otherwise(zero)

    counts = [only(op, "ops", F.lit(0)).alias(f"{p}count") for op, p in WIDE_PREFIX.items()]
    means = [only(op, "avg_latency", F.lit(0).cast("float")).alias(f"{p}average") for op, p in WIDE_PREFIX.items()]
    return measures.select(*kept, *counts, *means)


def node_error_text(
    rejects: DataFrame,
    exit_status: DataFrame,
    lines_per_part: int = 256,
) -> DataFrame:
    """The error text of every failed node (exit status other than 0), whole and in arrival order.

    A node's text may be of any size, so it comes in parts: part ``p`` of a file (or of a split of it) joins,
    without separator, the lines with ``seq`` from ``p * lines_per_part`` up to the next part. The parts of a node
    ordered by what ``rejects`` has of ``file_time``, ``file`` and ``split``, then ``part``, are the node's text, and
    no task ever holds more than one part.
    """
    failed = exit_status.filter(F.col("exit_status") != 0).select("node")
    source = [c for c in _SOURCE if c in rejects.columns]
    within = [c for c in arrival(rejects) if c not in source]
    ordered = F.array_sort(F.collect_list(F.struct(*within, "line")))
    return (
        rejects.join(failed, "node", "left_semi")
        .groupBy("node", *source, block(F.col("seq"), lines_per_part).alias("part"))
        .agg(
            F.array_join(F.transform(ordered, lambda e: e["line"]), "").alias("error_text"),
            F.count("*").alias("lines"),
        )
    )


def series_points(
    measures: DataFrame, metric: str = "ops", op: str = "INSERT", only_matching: bool = False
) -> DataFrame:
    """Chart points: x in seconds, y the count (``ops``) or mean (``latency``) of one operation type.

    Measures of another type give y = 0, as the charts do; ``only_matching`` leaves them out.
    """
    value = {"ops": F.col("ops"), "latency": F.col("avg_latency")}[metric]
    matching = F.col("op") == op
    kept = [c for c in measures.columns if c not in ("op", "ops", "avg_latency", "time")]
    rows = measures.filter(matching) if only_matching else measures
    y = F.when(matching, value.cast("double")).otherwise(F.lit(0.0))
    return rows.select(*kept, (F.col("time") / 1000).alias("x"), y.alias("y"))


def node_series(
    measures: DataFrame,
    metric: str = "ops",
    op: str = "INSERT",
    only_matching: bool = False,
    points_per_part: int = 4096,
) -> DataFrame:
    """Each node's points as arrays in arrival order, in parts of bounded size (see ``node_error_text``)."""
    points = series_points(measures, metric, op, only_matching)
    source = [c for c in _SOURCE if c in measures.columns]
    within = [c for c in arrival(measures) if c not in source]
    ordered = F.array_sort(F.collect_list(F.struct(*within, "x", "y")))
    return points.groupBy("node", *source, block(F.col("seq"), points_per_part).alias("part")).agg(
        F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")
    )


# What the measures of a window add up to.
RATE_TOTALS = "node string, op string, window_start bigint, measures bigint, operations bigint, weighted double"


def rate_totals(measures: DataFrame, window_ms: int) -> DataFrame:
    """Counts and sums by node, operation and tumbling window, which can be added to those of other measures."""
    start = F.col("time") - F.col("time") % F.lit(window_ms)
    return measures.groupBy("node", "op", start.alias("window_start")).agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count("*").alias("measures"),
        F.sum(F.col("ops").cast("long")).alias("operations"),
        F.sum(F.col("ops").cast("double") * F.col("avg_latency").cast("double")).alias("weighted"),
    ]


def rates(totals: DataFrame, window_ms: int) -> DataFrame:
    """Operations per second and count-weighted mean latency from ``rate_totals``."""
    total = F.col("operations")
    return totals.withColumns({
        "ops_per_second": total * 1000 / F.lit(window_ms),
        "mean_latency": F.when(total > 0, F.col("weighted") / total),
    }).drop("weighted")


def throughput(measures: DataFrame, window_ms: int) -> DataFrame:
    """Operations per second and count-weighted mean latency by node, operation and tumbling window.

    ``time`` is read as milliseconds; windows start at multiples of ``window_ms``. All aggregates combine
    on the map side, so a node with most of the rows costs the shuffle only its distinct windows.
    """
    return rates(rate_totals(measures, window_ms), window_ms)


def throughput_stream(measures: DataFrame, window_ms: int, delay: str) -> DataFrame:
    """``throughput`` over a stream in append mode: a window comes out once, when the watermark has passed its end.

    ``fleetlens.streaming.measures.start_throughput`` keeps the open windows and late measures as well.
    """
    span = f"{window_ms} milliseconds"
    totals = (
        measures.withColumn("ts", F.timestamp_millis("time"))
        .withWatermark("ts", delay)
        .groupBy("node", "op", F.window("ts", span).alias("_window"))
        .agg(*_totals())
        .withColumn("window_start", F.unix_millis(F.col("_window.start")))
        .drop("_window")
    )
    return rates(totals, window_ms)


def op_mix(measures: DataFrame, requested: DataFrame) -> DataFrame:
    """Observed share of each operation type next to the requested share, and the gap.

    ``requested`` has ``op`` and ``share``. Both sides of the join have one row per operation type.
    """
    per_op = measures.groupBy("op").agg(F.sum(F.col("ops").cast("long")).alias("operations"))
    everything = Window.partitionBy()  # over one row per operation type
    observed = per_op.withColumn("observed", F.col("operations") / F.sum("operations").over(everything))
    joined = observed.join(requested.select("op", F.col("share").alias("requested")), "op", "full_outer")
    return joined.select(
        "op",
        F.coalesce("operations", F.lit(0)).alias("operations"),
        F.coalesce("observed", F.lit(0.0)).alias("observed"),
        F.coalesce(F.col("requested").cast("double"), F.lit(0.0)).alias("requested"),
        (F.coalesce("observed", F.lit(0.0)) - F.coalesce(F.col("requested").cast("double"), F.lit(0.0))).alias("gap"),
    )
