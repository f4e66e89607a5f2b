"""The change feed and the role counts over streams of polls."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetlens.functions.times import DAY_MS
from fleetlens.operators.change_feed import ENTRY, feed_entries, name_key, operation_delta
from fleetlens.operators.inventory import node_liveness, role_counts
from fleetlens.operators.operations import recent_operations
from fleetlens.streaming.partials import Partials, added, newest, start_partials

_ENTRIES = f"_name string, entry {ENTRY}, touched bigint, batch bigint"
# Files of polls that one batch takes unless told otherwise.
MAX_FILES_PER_TRIGGER = 64


def read_polls(
    spark: SparkSession, path: str, schema: str | StructType, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER
) -> DataFrame:
    """A stream of polls from Parquet files. The limit on files bounds what a task sees of a name in a backlog."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def _remembered(spark: SparkSession, path: str, compact_every: int) -> Partials:
    return Partials(spark, path, _ENTRIES, newest(["_name"], ["batch"]), compact_every)


def start_operation_feed(
    polls: DataFrame, path: str, state: str, checkpoint: str, period: str | None = None, *, idle_ms: int = DAY_MS,
    span: int = 512, compact_every: int = 32, clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """``operation_delta`` over a stream of polls; each batch adds its news to ``path`` (``read_feed``).

    ``polls`` has the columns that ``operation_delta`` takes. Rows are decided in order of arrival: by batch, and by
    poll within a batch. A poll that arrives late is decided by the entry that it then finds; no row is lost.

    What the feed remembers of each name is a table under ``state``, one row per name. A batch reads the rows of its
    own names, composes each name's polls to one step per segment, decides its rows segment by segment, and stores the
    entries after it. So no task holds a name's rows, however many of a batch it has.

    A name that no poll has named for ``idle_ms`` of processing time is forgotten: its row is not read any more, and
    is gone with the next compaction, which runs every ``compact_every`` batches and where ``idle_ms`` have passed
    since the last batch. A batch that Spark repeats replaces what it stored before.
    """
    spark = polls.sparkSession
    entries = _remembered(spark, state, compact_every)
    _make_folder(spark, path)

    def decide(batch: DataFrame, number: int) -> None:
        now = int(clock() * 1000)
        fresh = F.col("touched") >= now - idle_ms
        stored = entries.read(before=number)
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            names = batch.select(name_key().alias("_name")).distinct()
            before = stored.where(fresh).join(names, "_name", "left_semi")
            operation_delta(batch, span, before).write.mode("overwrite").parquet(f"{path}/batch={number}")
            after = feed_entries(batch, before, span).select(
                "_name", "entry", F.lit(now).cast("long").alias("touched"), F.lit(number).cast("long").alias("batch"))
            # before the batch is stored, so that it is repeated from the same entries
            if number and (number % compact_every == 0 or stored.where(fresh).isEmpty()):
                entries.compact(number, fresh)
            entries.merge(after).write.mode("overwrite").parquet(f"{entries.path}/batch={number}")
        finally:
            batch.unpersist()

    trigger = {"processingTime": period} if period else {"availableNow": True}
    writer = polls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_feed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The news so far; ``schema`` is that of the polls."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def feed_memory(spark: SparkSession, state: str) -> DataFrame:
    """What the feed remembers: ``_name``, ``entry`` (NULL: nothing), ``touched``, ``batch``."""
    return _remembered(spark, state, 1).read()


def _make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def role_counts_stream(
    polled_instances: DataFrame, instant: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """``role_counts`` of each poll (``poll_id``), for a query in update mode.

    With ``instant``, a timestamp column that is the same for all rows of a poll, the state of a poll ends once the
    watermark has passed it; its rows that come even later no longer count. Without, every poll is kept.
    """
    if instant is None:
        return role_counts(polled_instances, by=["poll_id"])
    return role_counts(polled_instances.withWatermark(instant, delay), by=["poll_id", instant])


def latest_operation_stream(events: DataFrame, arrival: Sequence[str], name: str = "name") -> DataFrame:
    """``latest_operation`` live, for a query in update mode: the newest message of a name whenever one arrives. One
    state row per name."""
    message = F.struct(*(c for c in events.columns if c != name))
    newest = events.groupBy(name).agg(F.max_by(message, F.struct(*arrival)).alias("_newest"))
    return newest.select(name, "_newest.*").select(*events.columns)


def node_liveness_stream(
    states: DataFrame, order: Sequence[str], by: str = "node", alive: str = "alive"
) -> DataFrame:
    """``node_liveness`` live, for a query in update mode: the last known state of each node. One state row per node."""
    return node_liveness(states, order, by, alive)


def role_count_table(spark: SparkSession, path: str, key: str = "poll_id bigint") -> Partials:
    """``role_counts`` of each poll so far; counts of a poll's batches add up."""
    return Partials(
        spark, path, f"{key}, position int, label string, value bigint", added([key.split()[0], "position", "label"]))


def start_role_counts(
    polled_instances: DataFrame, counts: Partials, checkpoint: str, by: str = "poll_id", period: str | None = None
) -> StreamingQuery:
    """Keeps ``role_counts`` of each poll; rows of a poll count however late they come."""
    return start_partials(polled_instances, counts, checkpoint, lambda batch: role_counts(batch, by=[by]), period)


def liveness_table(spark: SparkSession, path: str, schema: str | StructType, order: Sequence[str], by: str = "node") -> Partials:
    """The last known state of each node, from states of this schema."""
    return Partials(spark, path, schema, newest([by], order))


def recent_operations_table(
    spark: SparkSession, path: str, schema: str | StructType, newest_first: Sequence[str], n: int = 50, by: str | None = None
) -> Partials:
    """The last ``n`` operations so far, or the last ``n`` of each group ``by``: a list that is capped as batches come.

    A batch stores at most ``n`` rows a group, and so does a compaction, whatever has passed through.
    """

    def merge(rows: DataFrame) -> DataFrame:
        return recent_operations(rows, newest_first, n, by).select(*rows.columns)

    return Partials(spark, path, schema, merge)
