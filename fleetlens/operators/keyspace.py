"""Keys: proportional assignment, hashed shards, balance, skew."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.digest import hash32, hash_fraction

# Operation types of a workload in the order of its proportions.
WORKLOAD_OPS = ("READ", "UPDATE", "SCAN", "INSERT")

# Proportions of a workload where none are given, and those that a test run starts with.
WORKLOAD_PROPORTIONS = {"READ": 0.75, "UPDATE": 0.25, "SCAN": 0.0, "INSERT": 0.0}
TEST_RUN_PROPORTIONS = {"READ": 0.8, "UPDATE": 0.2, "SCAN": 0.0, "INSERT": 0.0}


def assign_operations(df: DataFrame, key: str, proportions: dict[str, float] | None = None) -> DataFrame:
    """Adds ``op``: a repeatable split of the rows by key hash in the given proportions.

    Where the proportions sum to less than 1, the keys beyond get NULL. Per row; no shuffle.
    """
    proportions = WORKLOAD_PROPORTIONS if proportions is None else proportions
    shares = [proportions.get(name, 0.0) for name in WORKLOAD_OPS]
    bounds = dict(zip(WORKLOAD_OPS, accumulate(shares)))
    position = hash_fraction(F.col(key))
    return df.withColumn("op", F.coalesce(*(F.when(position < bound, F.lit(name)) for name, bound in bounds.items())))


def hash_shards(df: DataFrame, key: str, n: int, method: str = "md5") -> DataFrame:
    """Adds ``shard`` from 0 to n - 1. ``md5`` gives the same shard in any engine, ``xxhash64`` is faster."""
    hashed = {"md5": hash32, "xxhash64": F.xxhash64}[method](F.col(key))
    return df.withColumn("shard", F.pmod(hashed, F.lit(n)).cast("int"))


def shard_balance(df: DataFrame, key: str, n: int, method: str = "md5") -> DataFrame:
    """``shard``, ``rows``, ``share``, ``max_to_mean`` of all n shards, empty ones too."""
    # rows are counted per key on the map side, so that each distinct key is hashed once
    per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"))
    counts = hash_shards(per_key, "_key", n, method).groupBy("shard").agg(F.sum("_rows").alias("rows"))
    shards = df.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    rows = shards.join(counts, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows"))
    everything = Window.partitionBy()  # over n rows
    total = F.sum("rows").over(everything)
    return rows.select(
        "shard",
        "rows",
        (F.col("rows") / F.nullif(total, F.lit(0))).alias("share"),
        (F.max("rows").over(everything) * n / F.nullif(total, F.lit(0))).alias("max_to_mean"),
    )


def key_skew(df: DataFrame, key: str) -> DataFrame:
    """Rank-frequency table: ``key``, ``rows``, ``rank`` (dense, most frequent first), ``share``, ``cumulative_share``.

    Keys with equal counts share a rank, and ``cumulative_share`` covers all keys up to that rank. Ranks and
    running sums depend on the count alone, so they are found over the distinct counts. N rows have at most
    sqrt(2N) distinct counts, as d of them need 1 + 2 + ... + d rows: 1.5 million for 10^12 rows, at 32 bytes
    each, which is what the one unpartitioned window sees. The join back carries no hint: adaptive execution
    broadcasts the ranks by measured size, and splits the keys of a common count otherwise.
    """
    per_key = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    per_count = per_key.groupBy("rows").agg((F.col("rows") * F.count("*")).alias("_together"))
    frequent_first = Window.partitionBy().orderBy(F.col("rows").desc())
    total = F.sum("_together").over(Window.partitionBy())
    running = F.sum("_together").over(frequent_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = per_count.select(
        F.col("rows").alias("_rows"),
        F.row_number().over(frequent_first).alias("rank"),
        (F.col("rows") / total).alias("share"),
        (running / total).alias("cumulative_share"),
    )
    return per_key.join(ranks, F.col("rows") == F.col("_rows")).drop("_rows")
