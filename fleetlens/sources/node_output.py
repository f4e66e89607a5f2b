"""Output files of load-test nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetlens.functions.text import after_last, line_array
from fleetlens.operators.lines import split_lines

# The node is the folder that a file lies in; a `node=` before it, as partitioned writers put it, is no part of it.
_NODE = r"([^/=]+)/[^/]+$"
_ROW_IN_TASK = (1 << 33) - 1

# Files that one batch of a stream takes unless told otherwise.
MAX_FILES_PER_TRIGGER = 256


def read_node_output(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    whole_files: bool = False,
    max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
) -> DataFrame:
    """Lines of every node: ``node``, ``file_time``, ``file``, ``split``, ``seq``, ``piece``, ``line``, from
    ``<path>/<node>/<file>``.

    A node's lines arrived in the order of all columns between ``node`` and ``line`` (``ARRIVAL`` of the telemetry
    operators): its files by the time they were last written, then by name.

    Files of any size are split over tasks, in streams as well: ``split`` is the byte at which a split starts and
    ``seq`` the row's place in its task, which rises along the split whatever else the task reads. ``piece`` counts
    what a row holds between CRs, and the pieces of a line over 1 MiB. LF and CR each end a line, so CR LF leaves an
    empty line in between. A file that ends with a CR alone has an empty last line here.

    Spark numbers no rows of a stream, so ``seq`` is NULL there unless files are read whole; ``start_lines`` numbers the
    rows of each batch as it stores them.

    ``whole_files`` reads each file as one row and numbers its lines from 0 in ``seq``; for small files only.
    """
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", True)
    if streaming:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = [
        F.url_decode("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    ]
    if whole_files:
        texts = reader.text(path, wholetext=True).select(*source, "value")
        lines = split_lines(texts, "value").select(
            "*", F.lit(0).cast("long").alias("split"), F.col("line_no").alias("seq"), F.lit(0).alias("piece")
        )
    else:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK))
        rows = reader.text(path, lineSep="\n").select(
            *source,
            F.col("_metadata.file_block_start").alias("split"),
            (F.lit(None) if streaming else place).alias("seq"),
            line_array(F.col("value")).alias("_pieces"),
        )
        lines = rows.select("_path", "file_time", "split", "seq", F.posexplode("_pieces").alias("piece", "line"))
    return lines.select(
        F.regexp_extract("_path", _NODE, 1).alias("node"),
        "file_time",
        after_last(F.col("_path"), "/").alias("file"),
        F.col("split").cast("long").alias("split"),
        F.col("seq").cast("long").alias("seq"),
        "piece",
        "line",
    )


def start_lines(lines: DataFrame, path: str, checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Stores a stream of ``read_node_output`` under ``path``, exactly once, with ``seq`` as in batch (``read_lines``).

    A batch takes whole files and its rows pass no shuffle, so a row's place in its task rises along a split. A batch
    that Spark repeats replaces its own files. Without ``period`` it takes what is there and ends.
    """

    def store(batch: DataFrame, number: int) -> None:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK))
        batch.withColumn("seq", F.coalesce("seq", place)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": period} if period else {"availableNow": True}
    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The lines stored so far; ``schema`` is that of the stream."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
