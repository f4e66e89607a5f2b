"""Line formats of load-test output.

A format is a function from the line column to a struct column ``time long, op string, ops int,
avg_latency float`` whose ``op`` is NULL where the line is no measure. ``register_measure_format`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operation types and their codes.
OP_CODES = {"SCAN": 1, "INSERT": 2, "UPDATE": 3, "DELETE": 4, "READ": 5}

_GAP = r"[\x00-\x09\x0b-\x20]*"
_NAME = r"\[(?:%s)\](?:[^,\n]*\])?" % "|".join(OP_CODES)
_TIME = r"[0-9]{1,13}"
_MEAN = r"[0-9]{1,13}(?:\.[0-9]+)?"
_COUNT = r"[0-9]{1,13}"
# `[OP], time, mean, count`, then anything on the same line; a break is allowed only at the very end.
_MEASURE_LINE = (
    rf"\A{_NAME}{_GAP},{_GAP}{_TIME}{_GAP},{_GAP}{_MEAN}{_GAP},{_GAP}{_COUNT}{_GAP}"
    r"(?:,[^\n]*)?[\x00-\x20]*\z"
)

MeasureFormat = Callable[[Column], Column]


def bracketed_line(line: Column) -> Column:
    """``[OP], time, mean latency, count`` and any further tokens.

    One pattern accepts or rejects a line, and only an accepted line is split. The fields stand outside any
    condition, so that Spark splits once for all of them; its casts pass over the blanks around a number.
    """
    accepted = line.startswith("[") & line.rlike(_MEASURE_LINE)
    tokens = F.split(F.when(accepted, line), ",", 5)
    count = tokens.getItem(3).try_cast("int")  # NULL beyond 32 bits
    op = F.substring_index(F.substring(tokens.getItem(0), 2, 7), "]", 1)
    return F.struct(
        tokens.getItem(1).try_cast("long").alias("time"),
        F.when(count.isNotNull(), op).alias("op"),
        count.alias("ops"),
        tokens.getItem(2).try_cast("float").alias("avg_latency"),
    )


_formats: dict[str, MeasureFormat] = {"bracketed": bracketed_line}


def register_measure_format(name: str, parser: MeasureFormat) -> None:
    """Makes ``parser`` available under ``name``; a name is taken once."""
    if name in _formats and _formats[name] is not parser:
        raise ValueError(f"measure format {name!r} exists")
    _formats[name] = parser


def measure_format(name: str) -> MeasureFormat:
    if name not in _formats:
        raise ValueError(f"no measure format {name!r}; known: {', '.join(sorted(_formats))}")
    return _formats[name]
