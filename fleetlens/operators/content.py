"""Content by digest: differences between snapshots, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.digest import md5_number, without_leading_zeros


def content_digest(df: DataFrame, col: str) -> DataFrame:
    """Adds ``md5`` (written as a number, so without leading zeros) and ``sha1``."""
    return df.withColumns({"md5": md5_number(F.col(col)), "sha1": F.sha1(F.col(col))})


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """``key``, ``change``: added, removed, changed or same, with both digests.

    A key occurs once in a snapshot. Contents are digested where they are read; the shuffle carries keys and
    digests only, and both sides meet in one aggregation instead of a join.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        digest = F.md5(F.col(content))
        mine = {s: (digest if s == name else F.lit(None).cast("string")) for s in ("old", "new")}
        return df.select(
            key,
            *(mine[s].alias(f"{s}_digest") for s in mine),
            *(F.lit(s == name).alias(f"_in_{s}") for s in mine),
        )

    both = (
        side(old, "old")
        .unionByName(side(new, "new"))
        .groupBy(key)
        .agg(
            F.max("old_digest").alias("old_digest"),
            F.max("new_digest").alias("new_digest"),
            F.bool_or("_in_old").alias("_in_old"),
            F.bool_or("_in_new").alias("_in_new"),
        )
    )
    change = (
        F.when(~F.col("_in_old"), "added")
        .when(~F.col("_in_new"), "removed")
        .when(F.col("old_digest").eqNullSafe(F.col("new_digest")), "same")
        .otherwise("changed")
    )
    return both.select(
        key,
        change.alias("change"),
        without_leading_zeros(F.col("old_digest")).alias("old_digest"),
        without_leading_zeros(F.col("new_digest")).alias("new_digest"),
    )


def duplicate_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of rows with equal content: ``digest``, ``kept_key`` (the lowest), ``copies`` (2 or more).

    Only the lowest key and a count are kept per digest, combined on the map side, so a content with very
    many copies is no hot group.
    """
    groups = df.select(F.md5(F.col(content)).alias("digest"), F.col(key).alias("_key")).groupBy("digest")
    found = groups.agg(F.min("_key").alias("kept_key"), F.count("*").alias("copies")).filter("copies > 1")
    return found.withColumn("digest", without_leading_zeros(F.col("digest")))


def without_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """The rows whose key is the lowest among rows of equal content. ``key`` is unique."""
    digest = F.md5(F.col(content)).alias("_digest")
    lowest = df.select(digest, F.col(key)).groupBy("_digest").agg(F.min(key).alias(key)).select(key)
    return df.join(lowest, key, "left_semi")
