"""Backlogs of many files and long segments: what does not grow with the square, or with the number of files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.change_feed import operation_delta
from fleetlens.plans import telemetry_queries
from fleetlens.plans.queries import QUERIES


@pytest.fixture
def many_files(spark, tmp_path, monkeypatch):
    """Events of 300 rows, whose lines are written to 75 files or more; and where the queries keep their files."""
    kinds = F.array(*(F.lit(k) for k in ("view", "click", "purchase", "signup", "error")))
    spark.range(300).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.try_element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 11).cast("double").alias("value"),
    ).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(telemetry_queries, "_LINES_PER_FILE", 4)
    monkeypatch.setattr(telemetry_queries, "_BATCHES", 5, raising=False)
    monkeypatch.setattr(telemetry_queries, "scratch_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    return tmp_path


@pytest.mark.parametrize(
    "name, batch_name, state",
    [
        ("ran1_throughput_stream", "ran1_throughput", "throughput-state"),
        ("str1_measure_stream", "prj1_parse_measures", "measures-state"),
        ("src1_lines_stream", "src1_read_node_output", "lines-state"),
        ("agg2_error_text_stream", "agg2_error_text_rolled_files", "lines-state"),
        ("agg3_series_stream", "agg3_series_rolled_files", "lines-state"),
    ],
)
def test_many_files_arrive_in_few_batches(spark, many_files, monkeypatch, name, batch_name, state):
    got = QUERIES[name](spark, f"{many_files}/sf")
    got = got.localCheckpoint()
    batches = [n for n in os.listdir(f"{many_files}/{state}/commits") if n.isdigit()]
    assert 1 < len(batches) <= 5
    monkeypatch.setattr(telemetry_queries, "scratch_folder", lambda spark, purpose: f"{many_files}/batch-{purpose}")
    want = QUERIES[batch_name](spark, f"{many_files}/sf").select(*got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_few_files_keep_their_batches(spark, many_files):
    for files, share in ((1, 2), (10, 2), (11, 3), (50, 10)):
        folder = f"{many_files}/files-{files}"
        spark.range(files).repartition(files, "id").selectExpr("cast(id as string) AS value").write.option(
            "maxRecordsPerFile", 1).text(folder)
        assert telemetry_queries._files_per_batch(spark, folder, 2) == share


def test_long_segment_takes_time_by_its_rows(spark):
    """60,000 polls of one name in one segment, all of them news: adding each to an array of all would copy it."""
    rows = 60_000
    polls = spark.range(rows).select(
        F.lit("hot").alias("name"), F.col("id").alias("poll_id"), (F.col("id") * 10).alias("poll_ms"),
        (F.col("id") * 10 - 10).alias("cutoff_ms"), F.lit("RUNNING").alias("status"),
        F.lit("1970-01-01T00:00:00.000Z").alias("start_time"), F.lit("1970-01-01T00:00:00.000Z").alias("insert_time"))
    began = time.monotonic()
    assert operation_delta(polls, span=1_000_000).agg(F.count("*"), F.countDistinct("poll_id")).first() == (rows, rows)
    assert time.monotonic() - began < 25


@pytest.mark.parametrize("rows", [1, 127, 128, 129, 400])
def test_stretches_pass_their_entry_on(spark, rows):
    """Statuses change every third poll; only changes are news, within and across stretches."""
    polls = spark.range(1, rows + 1).select(
        F.lit("a").alias("name"), F.col("id").alias("poll_id"), (F.col("id") * 10).alias("poll_ms"),
        F.when(F.col("id") > 1, F.col("id") * 10 - 10).alias("cutoff_ms"),
        F.concat(F.lit("S"), F.call_function("div", F.col("id") - 1, F.lit(3)).cast("string")).alias("status"),
        F.lit("1970-01-01T00:00:00.000Z").alias("start_time"), F.lit("1970-01-01T00:00:00.000Z").alias("insert_time"))
    got = sorted(r["poll_id"] for r in operation_delta(polls, span=1000).select("poll_id").collect())
    assert got == list(range(1, rows + 1, 3))
