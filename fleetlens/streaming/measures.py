"""Live measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.telemetry import RATE_TOTALS, parse_measures, rate_totals, rates
from fleetlens.sources.node_output import MAX_FILES_PER_TRIGGER, read_node_output
from fleetlens.streaming.partials import Partials, added, start_partials

# How often measures, and operations with role counts, are fetched.
MEASURE_PERIOD = "1 second"
OPERATION_PERIOD = "4 seconds"


def measure_stream(
    spark: SparkSession, path: str, fmt: str = "bracketed", max_files_per_trigger: int = MAX_FILES_PER_TRIGGER
) -> DataFrame:
    """Measures of all nodes as their files arrive. Each query has its own checkpoint and sees all of them."""
    lines = read_node_output(spark, path, streaming=True, max_files_per_trigger=max_files_per_trigger)
    return parse_measures(lines, fmt)


def start(
    df: DataFrame, path: str, checkpoint: str, period: str | None = None, output_mode: str = "append"
) -> StreamingQuery:
    """Writes a stream to Parquet files, exactly once; without ``period`` it takes what is there and ends."""
    trigger = {"processingTime": period} if period else {"availableNow": True}
    writer = df.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)


def _totals(spark: SparkSession, path: str) -> Partials:
    return Partials(spark, path, RATE_TOTALS, added(["node", "op", "window_start"]))


def start_throughput(
    measures: DataFrame, path: str, checkpoint: str, window_ms: int, period: str | None = None
) -> StreamingQuery:
    """Keeps the totals of every window of a stream of measures under ``path``: what a batch adds to a window is
    stored per batch, so open windows are there and a late measure counts however late. No state in memory."""
    totals = _totals(measures.sparkSession, path)
    return start_partials(measures, totals, checkpoint, lambda batch: rate_totals(batch, window_ms), period)


def read_throughput(spark: SparkSession, path: str, window_ms: int) -> DataFrame:
    """``throughput`` of all batches so far."""
    return rates(_totals(spark, path).read(), window_ms)
