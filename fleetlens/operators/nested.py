"""Values of nested documents, wherever they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import scratch_folder


def find_values(df: DataFrame, json_col: str, field: str) -> DataFrame:
    """One row per value of ``field`` at any depth: the other columns, ``path`` from the top and ``value``.

    Documents are parsed once, into variants, which are taken apart level by level: the objects and arrays of a level
    are stored and read by the next, until there are none. So a document of any shape is spread over rows, and the
    jobs are as many as levels. As a value that is found is an answer, it is not searched itself. ``path`` holds the
    keys on the way, array elements by their number from 0, joined by ``/``; ``value`` is the text of a plain value and
    the JSON of an object or array; a JSON null is NULL. A text that is no JSON has no values.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c != json_col]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    level = df.select(row, F.lit("").alias("path"), F.try_parse_json(F.col(json_col)).alias("tree"))
    found = []
    while True:
        parts = level.lateralJoin(spark.tvf.variant_explode(F.col("tree").outer())).select(
            "row",
            F.concat("path", F.lit("/"), F.coalesce("key", F.col("pos").cast("string"))).alias("path"),
            (F.coalesce(F.col("key") == field, F.lit(False))).alias("hit"),
            F.col("value").alias("tree"),
        )
        folder = scratch_folder(spark, "tree-level")
        branch = F.schema_of_variant("tree").rlike("^(OBJECT|ARRAY)<.") & ~F.col("hit")
        parts.where(F.col("hit") | branch).write.parquet(folder)
        stored = spark.read.schema(parts.schema).parquet(folder)
        found.append(stored.where("hit"))
        level = stored.where(~F.col("hit")).select("row", "path", "tree")
        if level.isEmpty():
            break
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    return values.select("row.*", F.substring("path", 2, 1 << 30).alias("path"), F.col("tree").cast("string").alias("value"))
