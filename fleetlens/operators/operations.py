"""Operations: views, latest state, changes, most recent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.text import after_last
from fleetlens.operators.sequences import with_previous

# Status -> (text shown, label class); any other status shows itself with the last class.
STATUS_LABELS = {"DONE": ("done", "success"), "RUNNING": ("running", "info"), "PENDING": ("pending", "warning")}
OTHER_LABEL = "important"

SLICES = 256


def operation_view(ops: DataFrame) -> DataFrame:
    """The published fields of an operation; ``target`` is the last part of the link."""
    return ops.select(
        "name",
        F.col("insert_time").alias("date"),
        F.col("start_time").alias("start"),
        F.col("end_time").alias("end"),
        "progress",
        "status",
        "user",
        "optype",
        after_last(F.col("target_link"), "/").alias("target"),
    )


def status_label(df: DataFrame, col: str = "status") -> DataFrame:
    """Adds ``status_text`` and ``status_class``."""
    status = F.col(col)
    text: Column = status
    label: Column = F.lit(OTHER_LABEL)
    for value, (shown, css) in STATUS_LABELS.items():
        text = F.when(status == value, F.lit(shown)).otherwise(text)
        label = F.when(status == value, F.lit(css)).otherwise(label)
    return df.withColumns({"status_text": text, "status_class": label})


def latest_operation(events: DataFrame, arrival: Sequence[str], name: str = "name") -> DataFrame:
    """The newest message of every operation name.

    ``arrival`` columns order the messages and are unique per name. Spark keeps one row per name and input
    partition before the shuffle (window group limit), so a name with most messages does not matter. The
    list order is ``arrival`` descending; sort where it is shown.
    """
    newest = Window.partitionBy(name).orderBy(*(F.col(c).desc() for c in arrival))
    return events.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def status_changes(events: DataFrame, order: str, name: str = "name", span: int = 100_000) -> DataFrame:
    """Messages whose status differs from the previous status of that name, if that one was not DONE."""
    seen = with_previous(events, [name], order, ["status"], span)
    changed = (F.col("prev_status") != "DONE") & (F.col("status") != F.col("prev_status"))
    return seen.filter(changed)


def recent_operations(ops: DataFrame, newest_first: Sequence[str], n: int = 50, by: str | None = None) -> DataFrame:
    """The last ``n`` operations, newest first; with ``by``, the last ``n`` of each group and their ``position``.

    Each of several slices of a group is cut to its last ``n`` first, so no task sees a whole group, whatever ``n``.
    """
    order = [F.col(c).desc() for c in newest_first]
    if by is None:
        return ops.orderBy(*order).limit(n)

    def newest(rows: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("position", rank).filter(F.col("position") <= n)

    sliced = ops.withColumn("_slice", F.pmod(F.xxhash64(*newest_first), F.lit(SLICES)))
    return newest(newest(sliced, by, "_slice").drop("_slice", "position"), by)
