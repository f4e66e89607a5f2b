"""Text to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import MAX_LINE_CHARS, line_array, without_empty_tail


def split_lines(
    df: DataFrame, text_col: str, max_chars: int = MAX_LINE_CHARS, unit: str = "characters"
) -> DataFrame:
    """One row per line: ``line_no`` from 0 and ``line``; the other columns stay, the text goes.

    LF and CR each end a line. An empty tail is no line, so an empty or NULL text gives no rows. The work is
    per row: no shuffle. A line of ``max_chars`` or more goes on as the next line; with ``unit`` ``bytes`` that many bytes
    of UTF-8 count, and halves of characters become U+FFFD.
    """
    kept = [c for c in df.columns if c != text_col]
    # the lines are a column of their own, so that they are made once: generators share no subexpressions
    split = df.select(*kept, line_array(F.col(text_col), max_chars, unit).alias("_lines"))
    return split.select(*kept, F.posexplode(without_empty_tail(F.col("_lines"))).alias("line_no", "line"))
