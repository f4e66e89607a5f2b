"""Helpers of the operators: tables cut from their lineage, running sums without hot groups, components of links."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.session import scratch_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: no lineage to repeat after a lost executor."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs started inside hand rows to Python in batches of about this size, for rows of several kilobytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def running_start(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], amount: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same keys before this one, by bucket and order.

    Only sums per (keys, bucket) meet in one window per key; rows are ordered inside one bucket. So a key may
    hold any share of all rows as long as the caller's buckets split it. Keys and bucket must not be null.
    """
    df = df.withColumn("_amount", amount.cast("long"))
    per_bucket = df.groupBy(*keys, bucket).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, bucket])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_amount", "_start")
    )


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that can be reached.

    Stars are contracted until nothing changes: every id hands its smallest neighbour to its larger ones
    (large star), then to its smaller ones (small star). The number of links does not grow, each round is one
    shuffle on ids with map-side minima, and the rounds are logarithmic in the longest path. Nulls and links
    of an id with itself are left out; repeated links count once.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), purpose)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u are linked to the smallest of u and its neighbours
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        after = cut(small, purpose)
        # every id has one link, to its root, and no root has one: all stars are flat
        state = after.agg(F.count("*").alias("n"), F.countDistinct("u").alias("ids")).first()
        roots = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if state["n"] == state["ids"] and roots.isEmpty():
            ids = after.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.union(after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        edges = after
