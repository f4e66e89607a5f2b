"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree.

A chunk is cut anywhere, so its encoding may start inside a word. But the library cuts words from left to right
and looks at no more than the character after a word: once two chunks that overlap both start a word at the same
character, all their words from there on are the same, as long as the earlier chunk still sees what follows. Such
a start is a proven boundary. Tokens of a document are those of each chunk between its two boundaries. Where an
overlap holds no common start (one word longer than the overlap), the document is cut again with wider overlaps.

Defined results: a null text is an empty one (0 bytes, 0 tokens); repeated rows come out each; an empty table
gives no rows; other columns are not read. Special strings in a text count as one token, the library's default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import tokenizing
from fleetlens.llm.common import cut
from fleetlens.session import ship_package

STARTS = "array<struct<at:bigint,before:bigint>>"


def words_of(encoder: tokenizing.SpacedEncoder, text: str) -> Iterator[tuple[int, int]]:
    """(start, number of tokens) of each word as the library cuts the text; a special string is one word."""
    if encoder.library.normalizer is not None:
        raise ValueError("offsets are exact only for a vocabulary without a normalizer")
    at = 0
    found = encoder.split_special.finditer(text) if encoder.split_special else ()
    spans = [(m.start(), m.end()) for m in found] + [(len(text), len(text))]
    for begin, end in spans:
        for word, (start, _) in encoder.library.pre_tokenizer.pre_tokenize_str(text[at:begin]):
            yield at + start, len(encoder.model.tokenize(word))
        if begin < end:
            yield begin, 1
        at = end


def _chunk_counts(tokenizer: str, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(tokenizing.SpacedEncoder, tokenizer)
        # a special string that the chunk's end cuts off cannot be told from other text
        margin = max([1, *map(len, encoder.special)])
        for batch in batches:
            columns = batch.to_pydict()
            totals, heads, tails = [], [], []
            for k, text in zip(columns["k"], columns["text"]):
                before, head, tail = 0, [], []
                for start, n in words_of(encoder, text):
                    if k and start < overlap:
                        head.append({"at": k * chunk + start, "before": before})
                    if chunk <= start < min(chunk + overlap, len(text) - margin):
                        tail.append({"at": k * chunk + start, "before": before})
                    before += n
                totals.append(before), heads.append(head), tails.append(tail)
            starts = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), batch.column("chunks"), pa.array(totals, pa.int64()),
                 pa.array(heads, starts), pa.array(tails, starts)],
                names=["row", "k", "chunks", "total", "head", "tail"],
            )

    return count


def _chunks(chunk: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n = max(1, -(-len(text) // chunk))
                for k in range(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([n], pa.int64()),
                         pa.array([text[k * chunk : (k + 1) * chunk + overlap]], pa.string())],
                        names=["row", "k", "chunks", "text"],
                    )

    return split


def spliced_counts(long: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) for texts of (row, text), n_tokens null where an overlap has no common start."""
    chunks = long.select("row", "text").mapInArrow(
        _chunks(chunk, overlap), "row long, k long, chunks long, text string"
    )
    counted = cut(
        # one document's chunks go to many tasks
        chunks.repartition(max(1, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "row", "k")
        .mapInArrow(_chunk_counts(tokenizer, chunk, overlap),
                    f"row long, k long, chunks long, total long, head {STARTS}, tail {STARTS}"),
        "chunk-counts",
    )
    following = counted.select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    seam = F.array_min(F.array_intersect("tail.at", "next_head.at"))
    before = lambda starts: F.get(
        F.filter(starts, lambda s: s["at"] == F.col("seam")), F.lit(0))["before"]
    seams = counted.join(following, ["row", "k"], "left").withColumn("seam", seam)
    return seams.groupBy("row").agg(
        F.when(
            F.count(F.when((F.col("k") + 1 < F.col("chunks")) & F.col("seam").isNull(), 1)) == 0,
            F.sum(F.when(F.col("k") + 1 < F.col("chunks"), before("tail") - before("next_head"))
                  .otherwise(F.col("total"))),
        ).alias("n_tokens")
    )


def token_counts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 50_000,
    overlap_chars: int = 1_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text. ``tokenizer`` is a file that every executor has; it must be byte
    level, without a normalizer. Texts over ``chunk_chars`` characters are encoded in chunks."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(tokenizing.SpacedEncoder, tokenizer)
        for batch in batches:
            n = [encoder.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    whole = texts.where(F.length("text") <= chunk_chars).select("doc_id", n_bytes, "text").mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    long = cut(
        texts.where(F.length("text") > chunk_chars)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", n_bytes, "text"),
        "long-texts",
    )
    counts, open_rows, chunk, overlap = [], long, chunk_chars, min(overlap_chars, chunk_chars)
    while not open_rows.isEmpty():
        spliced = cut(spliced_counts(open_rows, tokenizer, chunk, overlap), "spliced-counts")
        counts.append(spliced.where("n_tokens is not null"))
        open_rows = open_rows.join(spliced.where("n_tokens is null"), "row", "left_semi")
        overlap *= 8
        chunk = max(chunk, 2 * overlap)
    for found in counts:
        whole = whole.unionByName(
            long.drop("text").join(found, "row").select("doc_id", "n_bytes", "n_tokens")
        )
    return whole
