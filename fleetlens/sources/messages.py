"""One JSON message per measure or operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.operations import operation_view
from fleetlens.operators.telemetry import measure_wide

# Fields of each message in order, and the unit that measures state.
MESSAGE_TYPES = {
    "measure": (
        "type string, node string, insertcount int, updatecount int, deletecount int, scancount int, readcount int, "
        "insertaverage float, updateaverage float, deleteaverage float, scanaverage float, readaverage float, "
        "time bigint, `time-unit` string"
    ),
    "operation": (
        "type string, name string, date string, start string, end string, progress int, status string, user string, "
        "optype string, target string"
    ),
}
TIME_UNIT = "SECONDS"


def messages(df: DataFrame, kind: str) -> DataFrame:
    """``value``: the JSON text of each measure (long form) or operation; absent fields are written as null."""
    if kind == "measure":
        rows = measure_wide(df).withColumn("time-unit", F.lit(TIME_UNIT))
    elif kind == "operation":
        rows = operation_view(df)
    else:
        raise ValueError(f"no message kind {kind!r}; known: {', '.join(MESSAGE_TYPES)}")
    fields: list[Column] = [F.lit(kind).alias("type")]
    fields += [F.col(f"`{name}`") for name in _field_names(kind) if name != "type"]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def _field_names(kind: str) -> list[str]:
    return [field.split(" ")[0].strip("`") for field in MESSAGE_TYPES[kind].split(", ")]


def write_messages(
    df: DataFrame, kind: str, path: str, checkpoint: str | None = None, period: str | None = None
) -> StreamingQuery | None:
    """Writes the messages as text files, one per line.

    A stream needs ``checkpoint`` and gives its query; without ``period`` it takes what is there and ends.
    """
    lines = messages(df, kind)
    if not df.isStreaming:
        lines.write.mode("append").text(path)
        return None
    if checkpoint is None:
        raise ValueError("a stream of messages needs a checkpoint folder")
    trigger = {"processingTime": period} if period else {"availableNow": True}
    writer = lines.writeStream.format("text").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)


def read_messages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The messages of one kind, typed; messages of other kinds in the same files are left out."""
    return spark.read.schema(MESSAGE_TYPES[kind]).json(path).filter(F.col("type") == kind)
