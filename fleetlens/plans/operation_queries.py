"""Bound queries of the operation and change-feed operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators.change_feed import operation_delta, with_cutoff
from fleetlens.operators.operations import (
    latest_operation,
    operation_view,
    recent_operations,
    status_changes,
    status_label,
)
from fleetlens.plans.registry import bound
from fleetlens.plans.updates import last_updates
from fleetlens.plans.views import OPERATIONS, POLLS, operations, polls
from fleetlens.session import scratch_folder
from fleetlens.sources.messages import read_messages, write_messages
from fleetlens.streaming.operations import (
    latest_operation_stream,
    read_feed,
    read_polls,
    recent_operations_table,
    start_operation_feed,
)
from fleetlens.streaming.partials import start_partials

_VIEW = """SELECT name, insert_time AS date, start_time AS start, end_time AS "end", progress, status, "user", optype,
  CASE WHEN contains(target_link, '/') THEN regexp_extract(target_link, '[^/]*$') ELSE target_link END AS target
FROM operations"""


@bound("prj4_operation_view", f"WITH {OPERATIONS} {_VIEW}")
def prj4_operation_view(spark, sf_dir):
    return operation_view(operations(spark, sf_dir))


@bound("snk1_write_operation_messages", f"WITH {OPERATIONS}, v AS ({_VIEW}) SELECT 'operation' AS type, * FROM v")
def snk1_write_operation_messages(spark, sf_dir):
    folder = scratch_folder(spark, "operation-messages")
    write_messages(operations(spark, sf_dir), "operation", folder)
    return read_messages(spark, folder, "operation")


@bound(
    "prj5_status_label",
    f"""WITH {POLLS} SELECT name, poll_id, status,
      CASE status WHEN 'DONE' THEN 'done' WHEN 'RUNNING' THEN 'running' WHEN 'PENDING' THEN 'pending' ELSE status END
        AS status_text,
      CASE status WHEN 'DONE' THEN 'success' WHEN 'RUNNING' THEN 'info' WHEN 'PENDING' THEN 'warning'
        ELSE 'important' END AS status_class
    FROM polls""",
)
def prj5_status_label(spark, sf_dir):
    return status_label(polls(spark, sf_dir).select("name", "poll_id", "status"))


@bound(
    "win1_latest_operation",
    f"""WITH {POLLS} SELECT * FROM polls
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY poll_id DESC) = 1""",
)
def win1_latest_operation(spark, sf_dir):
    return latest_operation(polls(spark, sf_dir), ["poll_id"])


@bound(
    "win2_status_changes",
    f"""WITH {POLLS}, seen AS (
      SELECT name, poll_id, status, lag(status) OVER (PARTITION BY name ORDER BY poll_id) AS prev_status FROM polls)
    SELECT * FROM seen WHERE prev_status <> 'DONE' AND prev_status <> status""",
)
def win2_status_changes(spark, sf_dir):
    changes = status_changes(polls(spark, sf_dir).select("name", "poll_id", "status"), "poll_id", span=100)
    return changes.select("name", "poll_id", "status", "prev_status")


# The feed rule row by row: every name walks through its polls with its cached entry (cs, ca).
_FEED = f"""WITH RECURSIVE {POLLS},
poll_list AS (
  SELECT poll_id, lag(poll_ms) OVER (ORDER BY poll_id) AS cutoff_ms
  FROM (SELECT DISTINCT poll_id, poll_ms FROM polls)),
obs AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY poll_id) AS rn,
    CASE WHEN length(start_time) > 0 THEN start_ms ELSE insert_ms END AS at_ms,
    cutoff_ms IS NULL OR upper(status) = 'RUNNING' OR coalesce(start_ms >= cutoff_ms + 1, false) AS hit
  FROM (SELECT p.*, l.cutoff_ms, epoch_ms(try_strptime(start_time, '%Y-%m-%dT%H:%M:%S.%gZ')) AS start_ms,
      epoch_ms(try_strptime(insert_time, '%Y-%m-%dT%H:%M:%S.%gZ')) AS insert_ms
    FROM polls p JOIN poll_list l ON l.poll_id = p.poll_id)),
walk AS (
  SELECT name, rn, poll_id, hit AS emitted, CASE WHEN hit AND status <> 'DONE' THEN status END AS cs,
    CASE WHEN hit AND status <> 'DONE' THEN at_ms END AS ca
  FROM obs WHERE rn = 1
  UNION ALL
  SELECT name, rn, poll_id, hit OR changed,
    CASE WHEN (hit OR changed) AND status <> 'DONE' THEN status WHEN changed THEN NULL ELSE ps END,
    CASE WHEN (hit OR changed) AND status <> 'DONE' THEN at_ms WHEN changed THEN NULL ELSE pa END
  FROM (
    SELECT *, ps IS NOT NULL AND ps <> status AND cutoff_ms IS NOT NULL AS changed
    FROM (
      SELECT o.*, CASE WHEN w.ca >= o.poll_ms - 86400000 THEN w.cs END AS ps,
        CASE WHEN w.ca >= o.poll_ms - 86400000 THEN w.ca END AS pa
      FROM walk w JOIN obs o ON o.name = w.name AND o.rn = w.rn + 1)))
SELECT o.name, o.poll_id, o.poll_ms, o.cutoff_ms, o.status, o.start_time, o.insert_time
FROM walk w JOIN obs o ON o.name = w.name AND o.rn = w.rn WHERE w.emitted
"""

# The hours at which 2024-01-10, 2024-01-20 and all later time begin, in polls; files of a period.
_TENTH, _TWENTIETH, _END = (19732 * 24, 19742 * 24, 1 << 40)
_FILES = 4

_FEED_COLUMNS = ("name", "poll_id", "poll_ms", "cutoff_ms", "status", "start_time", "insert_time")


@bound("win3_operation_delta", _FEED)
def win3_operation_delta(spark, sf_dir):
    return operation_delta(with_cutoff(polls(spark, sf_dir))).select(*_FEED_COLUMNS)


def _write_periods(rows, periods, feed):
    """Files of one period after the other; the rows are computed once for all periods."""
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        for earliest, latest in periods:
            period = rows.filter(F.col("poll_id").between(earliest, latest - 1))
            period.repartition(_FILES).write.mode("append").parquet(feed)
    finally:
        rows.unpersist()


def _streamed_feed(spark, sf_dir, periods):
    """The news of polls that arrive period by period, one batch each."""
    feed, folder = scratch_folder(spark, "polls"), scratch_folder(spark, "news")
    rows = with_cutoff(polls(spark, sf_dir), span=100).select(*_FEED_COLUMNS)
    _write_periods(rows, periods, feed)
    arriving = read_polls(spark, feed, rows.schema, max_files_per_trigger=_FILES)
    memory, checkpoint = scratch_folder(spark, "news-memory"), scratch_folder(spark, "news-state")
    start_operation_feed(arriving, folder, memory, checkpoint).awaitTermination()
    return read_feed(spark, folder, rows.schema)


@bound(
    "win3_null_and_empty_names",
    _FEED.replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1).replace(
        "FROM polls p JOIN poll_list", "FROM renamed p JOIN poll_list").replace(
        "poll_list AS (", """renamed AS (SELECT CASE WHEN length(name) = 4 THEN '=null' WHEN length(name) = 5 THEN '' ELSE name END AS name,
    poll_id * 1000000 + row_number() OVER (PARTITION BY poll_id ORDER BY name) AS poll_id, poll_ms + row_number() OVER (PARTITION BY poll_id ORDER BY name) AS poll_ms,
    status, start_time, insert_time FROM polls),
poll_list AS (""").replace("(SELECT DISTINCT poll_id, poll_ms FROM polls)", "(SELECT DISTINCT poll_id, poll_ms FROM renamed)").replace(
        "SELECT o.name, o.poll_id", "SELECT nullif(o.name, '=null') AS name, o.poll_id"),
)
def win3_null_and_empty_names(spark, sf_dir):
    """Names merged into NULL, the empty name and others, each row a poll of its own."""
    place = F.row_number().over(Window.partitionBy("poll_id").orderBy("name"))
    name = F.when(F.length("name") == 4, F.lit(None)).when(F.length("name") == 5, "").otherwise(F.col("name"))
    renamed = polls(spark, sf_dir).withColumn("_place", place).select(
        name.alias("name"), (F.col("poll_id") * 1_000_000 + F.col("_place")).alias("poll_id"),
        (F.col("poll_ms") + F.col("_place")).alias("poll_ms"), "status", "start_time", "insert_time")
    return operation_delta(with_cutoff(renamed, span=100_000_000), span=8_000_000).select(*_FEED_COLUMNS)


@bound("str2_operation_delta_stream", _FEED)
def str2_operation_delta_stream(spark, sf_dir):
    """The polls arrive in three periods of time; entries outlive their batch."""
    return _streamed_feed(spark, sf_dir, ((0, _TENTH), (_TENTH, _TWENTIETH), (_TWENTIETH, _END)))


@bound(
    "str2_late_polls",
    _FEED.replace(
        "PARTITION BY name ORDER BY poll_id) AS rn",
        f"PARTITION BY name ORDER BY CASE WHEN poll_id >= {_TWENTIETH} THEN 2 WHEN poll_id < {_TENTH} THEN 1 ELSE 0 END, "
        "poll_id) AS rn",
    ),
)
def str2_late_polls(spark, sf_dir):
    """The first period arrives after the second: late by days, and none of its rows is lost."""
    return _streamed_feed(spark, sf_dir, ((_TENTH, _TWENTIETH), (0, _TENTH), (_TWENTIETH, _END)))


@bound(
    "str2_hot_name",
    _FEED.replace("FROM polls p JOIN poll_list", "FROM renamed p JOIN poll_list").replace(
        "poll_list AS (", """renamed AS (SELECT CASE WHEN poll_id % 3 = 0 THEN 'op-hot' ELSE name END AS name,
    poll_id * 1000000 + row_number() OVER (PARTITION BY poll_id ORDER BY name) AS poll_id, poll_ms + row_number() OVER (PARTITION BY poll_id ORDER BY name) AS poll_ms,
    status, start_time, insert_time FROM polls),
poll_list AS (""").replace("(SELECT DISTINCT poll_id, poll_ms FROM polls)", "(SELECT DISTINCT poll_id, poll_ms FROM renamed)"),
)
def str2_hot_name(spark, sf_dir):
    """A third of all rows under one name, in three batches."""
    place = F.row_number().over(Window.partitionBy("poll_id").orderBy("name"))
    name = F.when(F.col("poll_id") % 3 == 0, "op-hot").otherwise(F.col("name"))
    renamed = polls(spark, sf_dir).withColumn("_place", place).select(
        name.alias("name"), (F.col("poll_id") * 1_000_000 + F.col("_place")).alias("poll_id"),
        (F.col("poll_ms") + F.col("_place")).alias("poll_ms"), "status", "start_time", "insert_time")
    feed, folder = scratch_folder(spark, "hot-polls"), scratch_folder(spark, "hot-news")
    rows = with_cutoff(renamed, span=100_000_000).select(*_FEED_COLUMNS)
    days = ((0, _TENTH), (_TENTH, _TWENTIETH), (_TWENTIETH, _END))
    _write_periods(rows, [(earliest * 1_000_000, latest * 1_000_000) for earliest, latest in days], feed)
    arriving = read_polls(spark, feed, rows.schema, max_files_per_trigger=_FILES)
    memory, checkpoint = scratch_folder(spark, "hot-memory"), scratch_folder(spark, "hot-state")
    start_operation_feed(arriving, folder, memory, checkpoint, span=8_000_000).awaitTermination()
    return read_feed(spark, folder, rows.schema)


@bound(
    "str4_latest_operation_stream",
    f"""WITH {POLLS} SELECT name, poll_id, poll_ms, status FROM polls
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY poll_id DESC) = 1""",
)
def str4_latest_operation_stream(spark, sf_dir):
    """The polls arrive in three batches, the last period first."""
    feed = scratch_folder(spark, "live-polls")
    rows = polls(spark, sf_dir).select("name", "poll_id", "poll_ms", "status")
    for earliest, latest in ((_TWENTIETH, _END), (0, _TENTH), (_TENTH, _TWENTIETH)):
        rows.filter(F.col("poll_id").between(earliest, latest - 1)).repartition(_FILES).write.mode("append").parquet(feed)
    arriving = read_polls(spark, feed, rows.schema, max_files_per_trigger=_FILES)
    return last_updates(spark, "latest", latest_operation_stream(arriving, ["poll_id"]), ["name"])


@bound(
    "srt1_recent_operations",
    f"WITH {OPERATIONS} SELECT name, insert_time, status FROM operations ORDER BY insert_time DESC, o_orderkey DESC LIMIT 50",
)
def srt1_recent_operations(spark, sf_dir):
    recent = recent_operations(operations(spark, sf_dir), ["insert_time", "o_orderkey"], 50)
    return recent.select("name", "insert_time", "status")


@bound(
    "srt1_many_recent_operations_by_type",
    f"""WITH {OPERATIONS} SELECT optype, name, CAST(row_number() OVER (PARTITION BY optype ORDER BY insert_time DESC, o_orderkey DESC) AS INTEGER) AS position
    FROM operations QUALIFY position <= 2500""",
)
def srt1_many_recent_operations_by_type(spark, sf_dir):
    recent = recent_operations(operations(spark, sf_dir), ["insert_time", "o_orderkey"], 2500, by="optype")
    return recent.select("optype", "name", "position")


@bound(
    "srt1_recent_operations_by_type",
    f"""WITH {OPERATIONS} SELECT optype, name, insert_time, status,
      CAST(row_number() OVER (PARTITION BY optype ORDER BY insert_time DESC, o_orderkey DESC) AS INTEGER) AS position
    FROM operations QUALIFY position <= 50""",
)
def srt1_recent_operations_by_type(spark, sf_dir):
    recent = recent_operations(operations(spark, sf_dir), ["insert_time", "o_orderkey"], 50, by="optype")
    return recent.select("optype", "name", "insert_time", "status", "position")


@bound(
    "srt1_recent_operations_by_type_stream",
    f"""WITH {OPERATIONS} SELECT optype, name, insert_time, status FROM operations
    QUALIFY row_number() OVER (PARTITION BY optype ORDER BY insert_time DESC, o_orderkey DESC) <= 50""",
)
def srt1_recent_operations_by_type_stream(spark, sf_dir):
    """The capped lists of operations that arrive in batches, in no order of time."""
    feed = scratch_folder(spark, "live-operations")
    rows = operations(spark, sf_dir).select("optype", "name", "insert_time", "status", "o_orderkey")
    rows.repartition(3 * _FILES, "o_orderkey").write.parquet(feed)
    arriving = read_polls(spark, feed, rows.schema, max_files_per_trigger=_FILES)
    lists = recent_operations_table(
        spark, scratch_folder(spark, "lists"), rows.schema, ["insert_time", "o_orderkey"], 50, "optype")
    start_partials(arriving, lists, scratch_folder(spark, "lists-state")).awaitTermination()
    return lists.read().drop("o_orderkey")
