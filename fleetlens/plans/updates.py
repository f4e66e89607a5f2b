"""What a query in update mode says last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_folder


def last_updates(spark: SparkSession, purpose: str, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row per key that a query in update mode gave over all its batches."""
    out = scratch_folder(spark, purpose)

    def store(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store)
    state = scratch_folder(spark, f"{purpose}-state")
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.option("basePath", out).parquet(out)
    kept = F.struct(*stream.columns)
    return stored.groupBy(*keys).agg(F.max_by(kept, "batch").alias("_last")).select("_last.*")
