"""Names to links, and planned against existing nodes.

No join here carries a broadcast hint: adaptive execution broadcasts a side whose measured size is below
the session's threshold, and splits skewed partitions of the larger side otherwise. Each lookup side is
reduced to one row per key first, on the map side, so a key that fills it neither multiplies rows nor
gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_links(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy(F.col("name").alias("_name")).agg(F.min_by("link", "listing_pos").alias("_link"))


def resolve_links(df: DataFrame, col: str, lookup: DataFrame) -> DataFrame:
    """Replaces a name by the link of the first entry of that name; an unknown or NULL name stays.

    ``lookup``: ``name``, ``link``, ``listing_pos`` (unique).
    """
    joined = df.join(_first_links(lookup), F.col(col) == F.col("_name"), "left")
    return joined.withColumn(col, F.coalesce("_link", F.col(col))).select(*df.columns)


def resolve_links_array(df: DataFrame, arr_col: str, lookup: DataFrame) -> DataFrame:
    """``resolve_links`` for each element of a list; positions are kept, and NULL and empty lists stay as they are.

    The lists are taken apart for the join and put together by a number that each row gets for it, so rows need no
    key of their own and a group is one row's list. The row travels with its first element; nothing is joined back.
    """
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*df.columns).alias("_whole"))
    elements = numbered.select("_row", "_whole", F.posexplode_outer(F.col("_whole")[arr_col]).alias("_pos", "_item"))
    first = F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_whole"))
    resolved = resolve_links(elements.select("_row", first.alias("_whole"), "_pos", "_item"), "_item", lookup)
    element = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_item"))
    lists = resolved.groupBy("_row").agg(
        F.first("_whole", ignorenulls=True).alias("_whole"), F.array_sort(F.collect_list(element)).alias("_items")
    )
    # collect_list keeps a NULL element, as its position is not NULL
    items = F.transform("_items", lambda e: e["_item"])
    whole = F.col("_whole")
    shown = [
        F.when(F.size("_items") > 0, items).otherwise(whole[c]).alias(c) if c == arr_col else whole[c].alias(c)
        for c in df.columns
    ]
    return lists.select(*shown)


def missing_nodes(planned: DataFrame, existing: DataFrame, name: str = "instance") -> DataFrame:
    """Planned nodes that do not exist yet."""
    return planned.join(existing.select(name).distinct(), name, "left_anti")


def existing_nodes(planned: DataFrame, existing: DataFrame, name: str = "instance") -> DataFrame:
    """Planned nodes that exist already and are skipped."""
    return planned.join(existing.select(name).distinct(), name, "left_semi")


def lookup_or_null(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key with the columns of its row in ``table`` (one row per key there); NULLs where it has none."""
    return keys.join(table, key, "left")
