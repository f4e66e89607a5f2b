"""The row before, per key, without giving a key's whole history to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.numbers import block


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], span: int = 100_000
) -> DataFrame:
    """Adds ``prev_<value>``: the value in the key's row before this one; NULL on the first.

    ``order`` is a whole number that no key has twice; keys are not NULL. A key's history is cut into segments of ``span``
    order numbers, and the window runs per segment; only the last row of each segment goes on to the next
    one. So a key that holds most of the rows is spread over its segments, and what is ordered per key is
    one row per segment.
    """
    keys = list(keys)
    staged = df.withColumn("_segment", block(F.col(order), span))
    current = F.struct(*values)
    within = Window.partitionBy(*keys, "_segment").orderBy(order)
    tails = staged.groupBy(*keys, "_segment").agg(F.max_by(current, order).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_segment")
    entering = tails.select(*keys, "_segment", F.lag("_tail").over(across).alias("_entering"))
    joined = staged.withColumn("_before", F.lag(current).over(within)).join(entering, [*keys, "_segment"], "left")
    before = F.coalesce("_before", "_entering")
    return joined.select(*df.columns, *(before[v].alias(f"prev_{v}") for v in values))
