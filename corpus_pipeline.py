"""The corpus pipeline: quality, toxicity, near-duplicates, mixing and packing over ``documents``.

Each stage is written as Parquet and read again by the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import mixing, near_dup, packing, quality, toxicity
from fleetlens.llm.common import cut
from fleetlens.session import scratch_folder

REJECT_QUALITY_BELOW = 0.3
REJECT_TOXIC_FROM = 0.3
# Shared shingles in a hundred of the union from which documents are near-duplicates; op2_near_documents has its own.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good ones; the others go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.scored(F.col("text"), model) >= REJECT_QUALITY_BELOW)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; the others go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scored(F.col("text"), model)["score"] < REJECT_TOXIC_FROM)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): every row as a struct with a number of its own, stored, so that each reading sees the same numbers."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "pipeline-rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id and, of its rows, the first. Rows are
    compared, not ids: an id may have several texts. Rows without an id and texts without words stay."""
    rows = numbered(docs)
    # without an id a row links with nothing, as a text without words does
    texts = rows.select("row", F.when(F.col("doc.doc_id").isNotNull(), F.col("doc.text")).alias("text"))
    found = near_dup.near_duplicates(texts, id_col="row", percent=NEAR_PERCENT)
    groups = found.select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc.doc_id").alias("doc_id"))
    first = F.min(F.struct("doc_id", "row"))["row"]
    kept = groups.join(ids, "row").groupBy("component_id").agg(first.alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: once per round of which it takes at least half of their words."""
    rows = numbered(docs)
    texts = rows.select("row", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "text", "source")))
    taken = mixing.taken(mixing.mix(texts, row_col="row")).where("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    repeats = taken.select("row", times.alias("times")).where("times > 0")
    mixed = rows.join(repeats, "row").withColumn("round", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return mixed.select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("packing", packing_stage),
]

# Trained scores cannot be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = scratch_folder(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
