"""Aggregates of a stream as files beside it: mergeable rows per batch, merged again when they are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class Partials:
    """What the batches of a stream add up to, complete at any time, late rows included.

    ``merge`` brings the rows of one key together; it must give the same however rows are grouped before, as sums, newest
    rows and top lists do: merge(a + b) = merge(merge(a) + merge(b)). Each batch is merged alone and stored under its
    number, so what is stored per batch is bounded by the keys in it, and a batch that Spark repeats after a failure
    replaces its own files. Reading merges the stored batches. Every ``compact_every`` batches they become one base;
    files that it replaces are deleted one compaction later, so that a reader may finish.

    The folder belongs to one checkpoint, as batch numbers do.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str | StructType, merge: Callable[[DataFrame], DataFrame],
        compact_every: int = 32,
    ):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge
        self.compact_every = compact_every

    def _stored(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(
            int(name.split("=")[1]) for name in names
            if name.startswith(f"{kind}=") and files.exists(done(f"{self.path}/{name}/_SUCCESS"))
        )

    def _delete(self, kind: str, numbers: Sequence[int]) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for number in numbers:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}"), True)

    def read(self, before: int | None = None) -> DataFrame:
        """The merged rows of all batches, or of those with a smaller number than ``before``."""
        bases = [b for b in self._stored("base") if before is None or b < before]
        base = bases[-1] if bases else -1
        batches = [b for b in self._stored("batch") if b > base and (before is None or b < before)]
        paths = [f"{self.path}/base={base}"] * bool(bases) + [f"{self.path}/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # the folder's name is no column
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)
        return self.merge(rows)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Stores what a batch adds; the same batch again replaces it."""
        if batch and batch % self.compact_every == 0:
            self.compact(batch)
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def compact(self, before: int, keep: Column | None = None) -> None:
        """Makes one base of all batches before this number, of those of its rows that are to be kept."""
        older = self._stored("base")
        if older and older[-1] >= before - 1:
            return  # by a batch that is repeated now
        merged = self.read(before)
        if keep is not None:
            merged = merged.where(keep)
        merged.write.mode("overwrite").parquet(f"{self.path}/base={before - 1}")
        if older:
            self._delete("batch", [b for b in self._stored("batch") if b <= older[-1]])
            self._delete("base", older[:-1])


def newest(keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merges to the last row of each key by ``order``. Names of columns are kept; a key may have any number of rows."""

    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
        return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*rows.columns)

    return merge


def added(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merges to the sums of all columns per key."""

    def merge(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*sums).select(*rows.columns)

    return merge


def start_partials(
    stream: DataFrame, partials: Partials, checkpoint: str, rows: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    period: str | None = None,
) -> StreamingQuery:
    """Stores ``rows`` of each batch of a stream; without ``period`` it takes what is there and ends."""
    trigger = {"processingTime": period} if period else {"availableNow": True}
    writer = stream.writeStream.foreachBatch(lambda batch, number: partials.put(rows(batch), number))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
