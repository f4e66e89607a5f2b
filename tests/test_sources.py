"""Files in, messages out, live measures, session."""

import hashlib
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.lines import split_lines
from fleetlens.operators.telemetry import (
    ARRIVAL,
    arrival,
    node_error_text,
    node_series,
    parse_measures,
    split_rejects,
    throughput,
    throughput_stream,
)
from fleetlens.session import scratch_folder
from fleetlens.sources.files import file_digests
from fleetlens.sources.messages import messages, read_messages, write_messages
from fleetlens.sources.node_output import read_lines, read_node_output, start_lines
from fleetlens.streaming.measures import (
    MEASURE_PERIOD,
    OPERATION_PERIOD,
    measure_stream,
    read_throughput,
    start,
    start_throughput,
)


def write(folder, node, name, content):
    os.makedirs(f"{folder}/{node}", exist_ok=True)
    with open(f"{folder}/{node}/{name}", "w", newline="") as f:
        f.write(content)


def test_lines_of_nodes(spark, tmp_path):
    write(tmp_path, "10.0.0.1", "out-1.log", "a\r\nb\n")
    write(tmp_path, "10.0.0.1", "out-2.log", "c")
    write(tmp_path, "node=n 2", "out.log", "d\re\n")
    whole = read_node_output(spark, str(tmp_path), whole_files=True).orderBy("node", "file", "seq").collect()
    assert [(r.node, r.file, r.seq, r.line) for r in whole] == [
        ("10.0.0.1", "out-1.log", 0, "a"),
        ("10.0.0.1", "out-1.log", 1, ""),
        ("10.0.0.1", "out-1.log", 2, "b"),
        ("10.0.0.1", "out-2.log", 0, "c"),
        ("n 2", "out.log", 0, "d"),
        ("n 2", "out.log", 1, "e"),
    ]
    split = read_node_output(spark, str(tmp_path)).orderBy("node", *ARRIVAL).collect()
    assert [(r.node, r.line) for r in split] == [(r.node, r.line) for r in whole]


def test_files_of_a_node_in_the_order_they_were_written(spark, tmp_path):
    """Names cross from 9 to 10; the command fails in the first file, so nothing of the second is a measure."""
    for n in (8, 9, 10):
        write(tmp_path, "n", f"{n}.log", f"[READ], {n}, 1, 1\n" + ("boom\n" if n == 9 else ""))
        os.utime(f"{tmp_path}/n/{n}.log", (1_700_000_000 + n, 1_700_000_000 + n))
    for whole in (False, True):
        lines = read_node_output(spark, str(tmp_path), whole_files=whole)
        assert [r.line for r in lines.orderBy(*ARRIVAL).collect()] == ["[READ], 8, 1, 1", "[READ], 9, 1, 1", "boom", "[READ], 10, 1, 1"]
        failures = lines.filter("line = 'boom'").groupBy("node").agg(F.min(F.struct(*arrival(lines))).alias("failed_from"))
        measures, rejects = split_rejects(lines, failures)
        assert sorted(r.time for r in measures.collect()) == [8, 9]
        status = spark.createDataFrame([("n", 1)], "node string, exit_status int")
        parts = node_error_text(rejects, status).orderBy("file_time", "file", "split", "part").collect()
        assert "".join(p.error_text for p in parts) == "boom[READ], 10, 1, 1"
        series = node_series(parse_measures(lines), op="READ").orderBy("file_time", "file", "split", "part").collect()
        assert [p.x for s in series for p in s.points] == [0.008, 0.009, 0.01]
        with pytest.raises(ValueError):
            split_rejects(lines, spark.createDataFrame([("n", 1)], "node string, failed_from long"))


def test_order_of_a_file_over_many_splits(spark, tmp_path):
    """A file split over tasks, next to small files that share tasks with its tail."""
    lines = [f"<{i}>" + "x" * (i % 50) for i in range(40000)]
    write(tmp_path, "big", "a.log", "\n".join(lines) + "\n")
    for i in range(20):
        write(tmp_path, "small", f"{i:02d}.log", f"s{i}\n" * 50)
    settings = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        read = read_node_output(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 10
        got = read.filter("node = 'big'").orderBy(*ARRIVAL).collect()
        assert [r.line for r in got] == lines and len({(r.split, r.seq) for r in got}) == len(lines)
        _, rejects = split_rejects(read)
        status = spark.createDataFrame([("big", 2)], "node string, exit_status int")
        parts = node_error_text(rejects, status).orderBy("file_time", "file", "split", "part").collect()
        assert "".join(p.error_text for p in parts) == "".join(lines) and max(p.lines for p in parts) <= 256
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_lines_come_in_pieces(spark, tmp_path):
    cap = 1 << 20
    write(tmp_path, "n", "a.log", "x" * (2 * cap + 3) + "\ny\n")
    got = read_node_output(spark, str(tmp_path)).select("piece", F.length("line").alias("n"), "seq").orderBy("seq", "piece").collect()
    assert [(r.piece, r.n) for r in got] == [(0, cap), (1, cap), (2, 3), (0, 1)]


def test_lines_are_cut_by_bytes_too(spark):
    """As a reader that decodes piece by piece has it, for characters of one to four bytes."""
    texts = ["aé€🙂" * 5, "🙂" * 9, "", "x" * 14, "é" * 7 + "\n" + "€" * 4 + "\r\n", "plain\nlines", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for cap in (2, 3, 5, 7):
        want = []
        for i, text in enumerate(texts):
            lines = []
            for line in (text or "").replace("\r", "\n").split("\n"):
                raw = line.encode()
                lines += [raw[k : k + cap].decode("utf-8", "replace") for k in range(0, len(raw) + 1, cap) if k == 0 or k <= len(raw)]
            if lines and lines[-1] == "":
                lines.pop()
            want += [(i, n, line) for n, line in enumerate(lines)]
        got = split_lines(df, "text", max_chars=cap, unit="bytes").orderBy("i", "line_no").collect()
        assert [tuple(r) for r in got] == want


def test_digests_of_files(spark, tmp_path):
    contents = {"b.pp": b"two", "a.pp": b"\n", "c.pp": bytes(range(256)), "empty one.pp": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = file_digests(spark, f"{tmp_path}/*.pp").collect()
    assert [(r.name, r.length, r.digest) for r in rows] == [
        (n, len(c), hashlib.md5(c).hexdigest().lstrip("0")) for n, c in sorted(contents.items())
    ]


def test_digests_of_large_files_and_folders(spark, tmp_path):
    """More than Spark can hold in a row, block by block; folders below are listed by tasks."""
    large = tmp_path / "deep" / "er" / "large.bin"
    large.parent.mkdir(parents=True)
    with open(large, "wb") as file:
        file.write(b"start")
        file.truncate((1 << 31) + 5)
    want, zeros = hashlib.md5(b"start"), bytes(1 << 20)
    for _ in range(2048):
        want.update(zeros)
    (tmp_path / "deep" / "_hidden").write_bytes(b"x")
    (tmp_path / "top.txt").write_bytes(b"top")
    rows = file_digests(spark, str(tmp_path)).collect()
    assert [(r.folder, r.name, r.length) for r in rows] == [("er", "large.bin", (1 << 31) + 5), (tmp_path.name, "top.txt", 3)]
    assert rows[0].digest == want.hexdigest().lstrip("0")
    small = file_digests(spark, f"file://{tmp_path}/top.*", block_bytes=2).collect()
    assert [(r.name, r.digest) for r in small] == [("top.txt", hashlib.md5(b"top").hexdigest().lstrip("0"))]
    assert file_digests(spark, f"{tmp_path}/*/large.bin").collect() == []  # a star stays within its part
    assert [r.name for r in file_digests(spark, f"{tmp_path}/deep/er/large.bin", 1 << 22).select("name").collect()] == ["large.bin"]


def test_measure_message(spark):
    lines = spark.createDataFrame([("n", 0, "[INSERT], 1500, 2.5, 7")], "node string, seq long, line string")
    text = messages(parse_measures(lines), "measure").first().value
    assert json.loads(text) == {
        "type": "measure", "node": "n", "insertcount": 7, "updatecount": 0, "deletecount": 0, "scancount": 0, "readcount": 0,
        "insertaverage": 2.5, "updateaverage": 0.0, "deleteaverage": 0.0, "scanaverage": 0.0, "readaverage": 0.0,
        "time": 1500, "time-unit": "SECONDS",
    }
    assert list(json.loads(text))[:3] == ["type", "node", "insertcount"]


def test_operation_message_keeps_nulls(spark):
    schema = "name string, insert_time string, start_time string, end_time string, progress int, status string, user string, optype string, target_link string"
    ops = spark.createDataFrame([("o", "t", None, None, 0, "PENDING", "u", "insert", "a/b")], schema)
    assert json.loads(messages(ops, "operation").first().value) == {
        "type": "operation", "name": "o", "date": "t", "start": None, "end": None, "progress": 0, "status": "PENDING",
        "user": "u", "optype": "insert", "target": "b",
    }
    folder = scratch_folder(spark, "messages")
    write_messages(ops, "operation", folder)
    lines = spark.createDataFrame([("n", 0, "[READ], 1, 2, 3")], "node string, seq long, line string")
    write_messages(parse_measures(lines), "measure", folder)
    assert read_messages(spark, folder, "operation").first().target == "b"
    assert [r.readcount for r in read_messages(spark, folder, "measure").collect()] == [3]
    with pytest.raises(ValueError):
        messages(ops, "event")


def fill(folder, files=5, rows=40):
    """Each file of a node holds one minute."""
    want = []
    for k in range(files):
        for node in ("a", "b"):
            lines = [f"[{'READ' if i % 3 else 'SCAN'}], {60000 * k + 1000 * i}, {i}.5, {i}" for i in range(rows)]
            want += [(node, line) for line in lines]
            write(folder, node, f"{k}.log", "\n".join([*lines, "noise", ""]))
    return want


def test_stream_of_measures_equals_batch(spark, tmp_path):
    want = fill(tmp_path)
    measures = measure_stream(spark, str(tmp_path), max_files_per_trigger=3)
    out, text_out = scratch_folder(spark, "out"), scratch_folder(spark, "text")
    start(measures, out, scratch_folder(spark, "state")).awaitTermination()
    got = spark.read.schema(measures.schema).parquet(out)
    batch = parse_measures(read_node_output(spark, str(tmp_path)))
    assert got.count() == len(want) and got.drop("seq").exceptAll(batch.drop("seq")).count() == 0
    # a second query has its own checkpoint and sees everything again
    write_messages(measures, "measure", text_out, checkpoint=scratch_folder(spark, "state")).awaitTermination()
    assert read_messages(spark, text_out, "measure").count() == len(want)
    with pytest.raises(ValueError):
        write_messages(measures, "measure", text_out)


def test_lines_of_a_stream_are_numbered_as_in_batch(spark, tmp_path):
    """Files in several batches and over a restart: the lines of every split in the order of its bytes."""
    fill(tmp_path, files=3)
    kept, state = scratch_folder(spark, "lines"), scratch_folder(spark, "state")
    for late in (False, True):
        if late:
            write(tmp_path, "a", "late.log", "".join(f"late {n}\rhalf {n}\n" for n in range(500)))
        stream = read_node_output(spark, str(tmp_path), streaming=True, max_files_per_trigger=2)
        start_lines(stream, kept, state).awaitTermination()
    got = read_lines(spark, kept, stream.schema)
    batch = read_node_output(spark, str(tmp_path))
    assert got.columns == batch.columns and got.filter("seq is null").isEmpty()
    in_order = [tuple(r) for r in got.orderBy("node", *ARRIVAL).select("node", "file", "line").collect()]
    assert in_order == [tuple(r) for r in batch.orderBy("node", *ARRIVAL).select("node", "file", "line").collect()]
    assert len(in_order) > 1200


def test_stream_delivers_once_over_restarts(spark, tmp_path):
    out, state = scratch_folder(spark, "out"), scratch_folder(spark, "state")
    write(tmp_path, "a", "1.log", "[READ], 1, 1, 1\n")
    for name in ("2.log", "3.log"):
        measures = measure_stream(spark, str(tmp_path))
        start(measures, out, state).awaitTermination()
        write(tmp_path, "a", name, "[READ], 2, 1, 1\n")
    start(measure_stream(spark, str(tmp_path)), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_throughput_stream_equals_batch_for_closed_windows(spark, tmp_path):
    fill(tmp_path)
    # 2 files of every minute a batch; nodes agree on the minute, so nothing is late
    measures = measure_stream(spark, str(tmp_path), max_files_per_trigger=2)
    rates = throughput_stream(measures, 10_000, "2 minutes")
    out = scratch_folder(spark, "rates")
    start(rates, out, scratch_folder(spark, "state")).awaitTermination()
    got = spark.read.schema(rates.schema).parquet(out)
    batch = throughput(parse_measures(read_node_output(spark, str(tmp_path))), 10_000)
    closed = batch.filter(F.col("window_start") + 10_000 <= 60000 * 4 + 39000 - 120_000)
    assert got.count() == closed.count() > 20
    assert got.select(*closed.columns).exceptAll(closed).count() == 0


def test_throughput_kept_per_batch_equals_batch_for_all_windows(spark, tmp_path):
    """Open windows and late files count: minute 0 arrives last, hours after the others."""
    fill(tmp_path)
    partials, checkpoint = scratch_folder(spark, "totals"), scratch_folder(spark, "state")
    for late in (False, True):
        if late:
            write(tmp_path, "a", "late.log", "[READ], 5, 1.5, 3\n[READ], 86400000, 2, 4\n")
        measures = measure_stream(spark, str(tmp_path), max_files_per_trigger=2)
        start_throughput(measures, partials, checkpoint, 10_000).awaitTermination()
        got = read_throughput(spark, partials, 10_000)
        batch = throughput(parse_measures(read_node_output(spark, str(tmp_path))), 10_000)
        assert got.columns == batch.columns and got.exceptAll(batch).count() == 0 and got.count() == batch.count() > 20


def test_periods():
    assert (MEASURE_PERIOD, OPERATION_PERIOD) == ("1 second", "4 seconds")


def test_scratch_folder_is_the_shared_one(spark):
    """The same on every master: the named folder, or else one beside the shared tables."""
    namespace = SimpleNamespace
    for master in ("local[2]", "spark://host:7077"):
        context = namespace(master=master, getConf=dict)
        named = namespace(conf={"spark.checkpoint.dir": "hdfs:///c/"}, sparkContext=context)
        assert scratch_folder(named, "x").startswith("hdfs:///c/x-")
        unset = namespace(conf={"spark.sql.warehouse.dir": "hdfs:///w"}, sparkContext=context)
        assert scratch_folder(unset, "x").startswith("hdfs:///w/scratch/x-")
