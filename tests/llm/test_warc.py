import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from conftest import with_clashes
from fleetlens.llm import warc
from fleetlens.llm.queries import QUERIES


def captures_of(spark, rows, tmp_path, **options):
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_warc(warc.captures(pages), f"{tmp_path}/w", **options)
    return warc.with_originals(warc.assemble(spark, f"{tmp_path}/w"))


PAGES = [
    (1, "http://a/", "x" * 2000), (2, None, "x" * 2000), (9, "http://c/\r\n", "x" * 2000), (3, "http://d/", None),
    (4, "http://e/é", ""), (5, "f", "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n" * 40), (6, "g", "y" * 999),
    (7, "h", "y" * 999), (8, "i", "ß日🙂\r\n\r\n" * 200_000), (10, "j", "ß日🙂\r\n\r\n" * 200_000), (None, "k", "z"),
]


def test_round_trip(spark, tmp_path):
    rows = captures_of(spark, PAGES, tmp_path, records_per_file=4).select(
        warc.field("page-id").cast("long").alias("page_id"), "request.target_uri", "response.warc_type",
        "block_bytes", "block_digest", "response.http_length", "response.payload_digest",
        warc.field("page-id", "original.metadata").cast("long").alias("refers_to"), "response.record_id", "response.refers_to",
        "original.block_digest",
    ).toDF("page_id", "uri", "kind", "bytes", "digest", "http", "payload", "refers_to", "record", "refers_record", "of_original").collect()
    assert len(rows) == len(PAGES)
    got = {r["page_id"]: r for r in rows}
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        r = got[page_id]
        assert (r["http"], r["payload"]) == (len(body), hashlib.sha1(body).hexdigest())
        if page_id in (1, 2, 8):
            assert (r["kind"], r["refers_to"]) == ("revisit", 10 if page_id == 8 else 9)
            assert r["refers_record"] == got[r["refers_to"]]["record"] and r["of_original"] == r["payload"]
        else:
            assert (r["kind"], r["refers_to"], r["bytes"], r["digest"]) == (
                "response", None, len(body), hashlib.sha1(body).hexdigest())


def test_the_original_is_found_by_its_record_alone(spark, tmp_path):
    """What a revisit refers to is read from the archive; without the response there is no original."""
    read = captures_of(spark, PAGES, tmp_path)
    gone = warc.assemble(spark, f"{tmp_path}/w").where(warc.field("page-id") != "9")
    rows = warc.with_originals(gone).where(F.col("response.warc_type") == "revisit").select(
        warc.field("page-id"), warc.field("page-id", "original.metadata")).collect()
    assert sorted(map(tuple, rows), key=str) == [("1", None), ("2", None), ("8", "10")]
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))
    assert b"refers-to-page" not in text and read.where("original is not null").count() == 3


def test_records_are_warc(spark, tmp_path):
    captures_of(spark, PAGES[:4], tmp_path)
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 12 and text.endswith(b"\r\n\r\n")
    assert text.count(b"WARC-Type: revisit") == 2 and text.count(b"WARC-Concurrent-To: <urn:uuid:") == 8


def test_members_and_a_cut_file(spark, tmp_path):
    """Archives of one gzip member per record are read as well; one that ends early is an error."""
    import pytest

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    assert [len(b) for _, b in warc._walk(memoryview(gzip.compress(record) * 3))] == [21] * 3
    with pytest.raises(ValueError):
        list(warc._walk(memoryview(gzip.compress(record[:-10]))))


def test_repeated_rows_and_no_rows(spark, tmp_path):
    rows = captures_of(spark, [(1, "u", "q" * 1500)] * 3, tmp_path).select("response.warc_type").collect()
    assert sorted(r[0] for r in rows) == ["response", "revisit", "revisit"]
    (tmp_path / "none").mkdir()
    assert captures_of(spark, [], tmp_path / "none").collect() == []


def test_query_reads_every_page(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op7_warc_round_trip"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.where(F.col("record_type").isNull() | F.col("payload_digest").isNull()).isEmpty()
