"""WARC archives: captures written as records of a transaction, read back and assembled by their identifiers.

A capture is three records: request, response (or revisit) and metadata. Request and metadata name the response
they belong to in ``WARC-Concurrent-To``; reading joins the three through it and gives one nested row per capture. A
revisit names the response that it repeats in ``WARC-Refers-To``; ``with_originals`` joins the two by record identifiers.
Records are plain Column expressions and Spark's own writer puts them into gzipped files; a reader walks through
each file by the records' ``Content-Length``, decompressing as it goes.

Defined results: a null html is an empty payload; a null url is an empty address; rows that repeat are captures
of their own; of equal payloads of at least ``least_bytes`` the row with the largest id (the last of equal ids)
is the response; an empty table writes no file and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import cut
from fleetlens.session import ship_package

CRLF = "\r\n"
END = CRLF + CRLF
# The revisit profile of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
BATCH_BYTES = 16_000_000

RECORDS = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("block_bytes", T.LongType()), T.StructField("http_length", T.LongType()),
    T.StructField("fields", T.StringType()), T.StructField("block", T.BinaryType()),
])


def _record_id(kind: str, capture: str = "capture"):
    """A name-based UUID of the capture and the kind of record."""
    digest = F.md5(F.concat(F.lit(f"{kind} "), F.col(capture)))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000
) -> DataFrame:
    """One row per page with its digest and, for a revisit, the page that it repeats (``original``).

    The largest id per payload is found by digest and length alone; a payload that fills a third of the table is
    reduced to one row per task before the shuffle, and the join back may be split where it is skewed.
    """
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        # line breaks would end the header
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "").alias("url"),
        body.alias("body"),
    ).withColumns({
        "digest": F.sha1("body"), "size": F.octet_length("body").cast("long"),
        "at": F.monotonically_increasing_id(),
    })
    key = F.when(F.col("size") >= least_bytes, F.concat_ws("-", F.col("digest"), F.col("size").cast("string")))
    rows = rows.withColumn("key", key)
    last = rows.where("key is not null").groupBy("key").agg(
        F.max(F.struct(F.col("page_id"), F.col("at"))).alias("last"), F.count("*").alias("copies")
    ).where("copies > 1").select("key", "last")
    return rows.join(last, "key", "left").select(
        "page_id", "url", "body", "digest", "size", "at",
        F.coalesce(~F.struct("page_id", "at").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
        .alias("revisit"),
        F.col("last.page_id").alias("original"), F.col("last.at").alias("original_at"),
    ).withColumns({
        "capture": F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("at").cast("string")),
        "original_capture": F.concat_ws(
            "/", F.coalesce(F.col("original").cast("string"), F.lit("")), F.col("original_at").cast("string")),
    })


def _record(kind, record_id, extra, content_type: str, block):
    """A whole record but for its last four bytes, which the writer adds; bytes are carried through a string."""
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id,
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z"), extra,
        F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(F.encode(head, "UTF-8"), block).cast("string")


def write_warc(captured: DataFrame, path: str, *, records_per_file: int = 30_000) -> None:
    """Writes three records per capture. Files hold at most ``records_per_file`` records and one task's rows."""
    line = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    response_id = _record_id("response")
    uri = line("WARC-Target-URI", F.col("url"))
    http = F.encode(F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("size").cast("string"), F.lit(END)), "UTF-8")
    revisit = F.col("revisit")
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), response_id,
        F.concat(
            uri, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, F.concat(
                line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id("response", "original_capture"))
            )).otherwise(F.lit("")),
        ),
        "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    request = _record(
        F.lit("request"), _record_id("request"), F.concat(uri, line("WARC-Concurrent-To", response_id)),
        "application/http; msgtype=request",
        F.encode(F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}")), "UTF-8"),
    )
    metadata = _record(
        F.lit("metadata"), _record_id("metadata"), F.concat(uri, line("WARC-Concurrent-To", response_id)),
        "application/warc-fields",
        F.encode(F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)), "UTF-8"),
    )
    records = captured.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def _walk(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a gzipped file, holding one record and one read at a time."""
    unzip, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal unzip, at
        while True:
            if unzip.eof:  # the next member of the file
                given, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                given = b""
            if not given:
                if at >= len(content):
                    return False
                given = content[at : at + READ_BYTES]
                at += READ_BYTES
            got = unzip.decompress(given)
            if got:
                held.extend(got)
                return True

    while True:
        while (end := held.find(END.encode())) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(header["content-length"])
        begin, stop = end + len(END), end + len(END) + size + len(END)
        while len(held) < stop:
            if not more():
                raise ValueError("an archive ends within a record")
        yield header, bytes(held[begin : begin + size])
        del held[:stop]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives under a path. ``block`` is what follows the HTTP header of a
    response; ``fields`` is the text of a metadata record."""
    ship_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.name for f in RECORDS]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for header, block in _walk(memoryview(content.as_buffer())):
                    kind, http_length, fields = header["warc-type"], None, None
                    if kind in ("response", "revisit"):
                        head, _, block = block.partition(END.encode())
                        for x in head.decode("latin-1").split(CRLF):
                            if x.lower().startswith("content-length:"):
                                http_length = int(x.partition(":")[2])
                    elif kind == "metadata":
                        fields, block = block.decode("utf-8", "replace"), b""
                    rows.append((
                        kind, header.get("warc-record-id"), header.get("warc-concurrent-to"),
                        header.get("warc-refers-to"), header.get("warc-target-uri"),
                        (header.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        len(block), http_length, fields, block))
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) >= 5000:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and the metadata concurrent to it.

    Every identifier belongs to one capture, so each group is three records and no key is hot. A request or
    metadata record whose response is missing gives a row with a null ``response``.
    """
    of_response = F.col("warc_type").isin("response", "revisit")
    part = lambda kind: F.max(F.when(kind, F.struct(
        "record_id", "warc_type", "target_uri", "payload_digest", "http_length", "refers_to", "fields")))
    grouped = records.withColumn(
        "capture", F.when(of_response, F.col("record_id")).otherwise(F.col("concurrent_to"))
    ).groupBy("capture")
    return grouped.agg(
        part(F.col("warc_type") == "request").alias("request"), part(of_response).alias("response"),
        part(F.col("warc_type") == "metadata").alias("metadata"),
        F.max(F.when(F.col("warc_type") == "response", F.col("digest"))).alias("block_digest"),
        F.max(F.when(F.col("warc_type") == "response", F.col("block_bytes"))).alias("block_bytes"),
    )


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under a path, nested, with the digest computed from what was read."""
    return transactions(read_records(spark, path).withColumn("digest", F.sha1("block")))


def with_originals(assembled: DataFrame) -> DataFrame:
    """Adds ``original``: the capture whose response a revisit refers to; null for others and where it is missing.

    The captures are stored first; a response that a third of all captures refer to is then split where they join.
    """
    stored = cut(assembled, "warc-captures")
    responses = stored.where(F.col("response.warc_type") == "response").select(
        F.col("response.record_id").alias("_refers_to"), F.struct(*stored.columns).alias("original"))
    refers_to = F.when(F.col("response.warc_type") == "revisit", F.col("response.refers_to"))
    return stored.withColumn("_refers_to", refers_to).join(responses, "_refers_to", "left").drop("_refers_to")


def field(name: str, of: str = "metadata"):
    """The value of a line of the metadata record; null if it has none."""
    value = F.regexp_extract(f"{of}.fields", f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(value != "", value)
