"""Bounded samples of labelled or plain documents, taken by hash, and folds that labels are never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample_ids(ids: DataFrame, bound: int, salt: int) -> DataFrame:
    """At most ``bound`` distinct ids, the first by salted hash: the same ids in each run. Column ``doc_id`` only is
    distinct; other columns are kept from one of its rows."""
    once = ids.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.orderBy(F.xxhash64(F.lit(salt), F.col("doc_id")), "doc_id").limit(bound)
