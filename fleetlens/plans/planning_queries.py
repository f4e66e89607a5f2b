"""Bound queries of the planning, key, validation and content operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.content import content_digest, duplicate_content, snapshot_diff, without_duplicates
from fleetlens.operators.keyspace import assign_operations, hash_shards, key_skew, shard_balance
from fleetlens.operators.planning import (
    assign_key_range,
    cluster_plan,
    config_string,
    key_ranges,
    microshard_layout,
    shard_endpoints,
)
from fleetlens.operators.validation import error_report, rules, validate_rows
from fleetlens.plans.registry import bound
from fleetlens.plans.views import HOSTS, PLAN, RUN_FORMS, SPECS, hosts, run_forms, specs, table, text


@bound(
    "jon5_shard_endpoints",
    f"""WITH {PLAN}
    SELECT p.instance AS node, CAST(27040 + i AS INTEGER) AS port, p.instance || ':' || (27040 + i) AS endpoint
    FROM planned_nodes p JOIN specs s ON s.cluster = p.cluster, LATERAL (SELECT unnest(generate_series(0, s.processes - 1)) AS i)
    WHERE p.role = 'shard'""",
)
def jon5_shard_endpoints(spark, sf_dir):
    clusters = specs(spark, sf_dir)
    nodes = cluster_plan(clusters).filter((F.col("role") == "shard") & F.col("disk").endswith("-disk-root"))
    with_processes = nodes.join(clusters.select("cluster", "processes"), "cluster")
    ends = shard_endpoints(with_processes.select(F.col("instance").alias("node"), "processes"))
    return ends.select("node", "port", "endpoint")


@bound(
    "agg5_config_string",
    f"""WITH {PLAN} SELECT cluster, string_agg(instance || ':27019', ',' ORDER BY n) AS config_db
    FROM planned_nodes WHERE role = 'conf' GROUP BY cluster""",
)
def agg5_config_string(spark, sf_dir):
    plan = cluster_plan(specs(spark, sf_dir))
    nodes = plan.filter((F.col("role") == "conf") & F.col("disk").endswith("-disk-root"))
    number = F.substring_index("instance", "-", -1).cast("int")
    return config_string(nodes.select("cluster", F.col("instance").alias("node"), number.alias("listing_pos")))


_RUNS = """runs AS (SELECT p_partkey, p_partkey * 10 + p_size AS record_count, p_size % 7 + 1 AS nodes FROM part)"""


@bound(
    "gen1_key_ranges",
    f"""WITH {_RUNS} SELECT p_partkey, record_count, nodes, CAST(i AS INTEGER) AS node,
      (record_count // nodes) * (i - 1) AS start_key, (record_count // nodes) * i AS end_key,
      record_count - (record_count // nodes) * nodes AS unowned
    FROM runs, LATERAL (SELECT unnest(generate_series(1, nodes)) AS i)""",
)
def gen1_key_ranges(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") * 10 + F.col("p_size")).alias("record_count"), (F.col("p_size") % 7 + 1).alias("nodes")
    )
    return key_ranges(runs)


@bound(
    "gen1_assign_key_range",
    """WITH n AS (SELECT count(*) // 7 AS per_node FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey < per_node * 7 THEN o_orderkey // per_node + 1 END AS node FROM orders, n""",
)
def gen1_assign_key_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    records = orders.agg(F.count("*")).scalar()
    return assign_key_range(orders.select("o_orderkey"), "o_orderkey", records, 7)


@bound(
    "gen2_cluster_plan",
    f"""WITH {PLAN}
    SELECT cluster, role, instance, tag || ',' || cluster AS tags, instance || '-disk-root' AS disk,
      CAST(root_disk_gb AS BIGINT) AS size_gb FROM planned_nodes
    UNION ALL SELECT cluster, role, instance, tag || ',' || cluster, instance || '-disk' || d, data_disk_gb
    FROM planned_nodes, LATERAL (SELECT unnest(generate_series(1, disks)) AS d)""",
)
def gen2_cluster_plan(spark, sf_dir):
    return cluster_plan(specs(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@bound(
    "gen3_microshard_layout",
    f"""WITH {HOSTS}
    SELECT host, CAST(i AS INTEGER) AS process, CAST(27040 + i - 1 AS INTEGER) AS port,
      ((mem_total_kb // 1024 - 1) // processes) * 1048576 AS memory_bytes,
      CAST(greatest(1, 1024 // processes) AS BIGINT) AS cpu_shares, '0-' || (cores - 1) AS cpus,
      '/mnt/mongodb/' || CASE WHEN raid_type = 'raid0' AND fs_type = 'btrfs' THEN list_sort(dirs)[1] || '/' || i
        WHEN raid_type = 'raid0' THEN 'md0/' || i ELSE coalesce(list_sort(dirs)[i], '') END AS data_dir,
      '/tmp/mongodb-shard-' || i || '.log' AS log_path
    FROM hosts, LATERAL (SELECT unnest(generate_series(1, processes)) AS i)""",
)
def gen3_microshard_layout(spark, sf_dir):
    return microshard_layout(hosts(spark, sf_dir))


_HASH32 = "CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


@bound(
    "ran3_assign_operations",
    f"""SELECT o_orderkey, CASE WHEN h < 0.5 THEN 'READ' WHEN h < 0.75 THEN 'UPDATE' WHEN h < 0.875 THEN 'SCAN'
      ELSE 'INSERT' END AS op FROM (SELECT o_orderkey, {_HASH32.format(key="o_orderkey")} / 4294967296 AS h FROM orders)""",
)
def ran3_assign_operations(spark, sf_dir):
    shares = {"READ": 0.5, "UPDATE": 0.25, "SCAN": 0.125, "INSERT": 0.125}
    return assign_operations(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", shares)


@bound(
    "ran4_hash_shards",
    f"SELECT o_orderkey, CAST({_HASH32.format(key='o_orderkey')} % 12 AS INTEGER) AS shard FROM orders",
)
def ran4_hash_shards(spark, sf_dir):
    return hash_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 12)


@bound(
    "ran4_shard_balance",
    f"""WITH placed AS (SELECT {_HASH32.format(key="l_partkey")} % 12 AS shard FROM lineitem),
    counted AS (SELECT s.shard, count(p.shard) AS rows FROM range(12) s(shard) LEFT JOIN placed p ON p.shard = s.shard GROUP BY s.shard)
    SELECT CAST(shard AS INTEGER) AS shard, rows, round(rows / sum(rows) OVER (), 9) AS share,
      round(max(rows) OVER () * 12 / sum(rows) OVER (), 9) AS max_to_mean FROM counted""",
)
def ran4_shard_balance(spark, sf_dir):
    balance = shard_balance(table(spark, sf_dir, "lineitem"), "l_partkey", 12)
    return balance.withColumns({"share": F.round("share", 9), "max_to_mean": F.round("max_to_mean", 9)})


@bound(
    "ran5_key_skew",
    """WITH counted AS (SELECT l_partkey AS key, count(*) AS rows FROM lineitem GROUP BY l_partkey)
    SELECT key, rows, CAST(dense_rank() OVER (ORDER BY rows DESC) AS INTEGER) AS rank,
      round(rows / sum(rows) OVER (), 9) AS share,
      round(sum(rows) OVER (ORDER BY rows DESC RANGE UNBOUNDED PRECEDING) / sum(rows) OVER (), 9) AS cumulative_share
    FROM counted""",
)
def ran5_key_skew(spark, sf_dir):
    skew = key_skew(table(spark, sf_dir, "lineitem"), "l_partkey")
    return skew.withColumns({"share": F.round("share", 9), "cumulative_share": F.round("cumulative_share", 9)})


@bound(
    "prj8_content_digest",
    "SELECT doc_id, regexp_replace(md5(text), '^0+', '') AS md5, sha1(text) AS sha1 FROM documents",
)
def prj8_content_digest(spark, sf_dir):
    return content_digest(table(spark, sf_dir, "documents"), "text").select("doc_id", "md5", "sha1")


# The newer snapshot: documents labelled toxic are gone, those in French have one more line, pages are new.
_SNAPSHOTS = """
old_files AS (SELECT 'doc-' || doc_id AS name, text AS content FROM documents),
new_files AS (
  SELECT 'doc-' || d.doc_id AS name, CASE WHEN lang = 'fr' THEN text || chr(10) || 'seen' ELSE text END AS content
  FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT 'page-' || page_id, html FROM pages)
"""


@bound(
    "jon6_snapshot_diff",
    f"""WITH {_SNAPSHOTS}, digests AS (
      SELECT coalesce(o.name, n.name) AS name, ltrim(md5(o.content), '0') AS old_digest, ltrim(md5(n.content), '0') AS new_digest
      FROM old_files o FULL JOIN new_files n ON o.name = n.name)
    SELECT name, CASE WHEN old_digest IS NULL THEN 'added' WHEN new_digest IS NULL THEN 'removed'
      WHEN old_digest = new_digest THEN 'same' ELSE 'changed' END AS change, old_digest, new_digest FROM digests""",
)
def jon6_snapshot_diff(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), text("doc_id")).alias("name")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    content = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nseen"))).otherwise(F.col("text"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), text("page_id")).alias("name"), F.col("html").alias("content")
    )
    old = documents.select(name, F.col("text").alias("content"))
    new = documents.join(toxic, "doc_id", "left_anti").select(name, content.alias("content")).unionByName(pages)
    return snapshot_diff(old, new, "name", "content")


@bound(
    "ran6_duplicate_content",
    """SELECT ltrim(md5(text), '0') AS digest, min(doc_id) AS kept_key, count(*) AS copies
    FROM documents GROUP BY text HAVING count(*) > 1""",
)
def ran6_duplicate_content(spark, sf_dir):
    return duplicate_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@bound(
    "ran6_without_duplicates",
    "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def ran6_without_duplicates(spark, sf_dir):
    return without_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_chars")


def _errors_sql(checks: list[tuple[str, str, str]]) -> str:
    """The errors of a row as one text, from (field, message, condition)."""
    found = ", ".join(f"CASE WHEN {broken} THEN '{field}: {message}' END" for field, message, broken in checks)
    return f"array_to_string(list_filter([{found}], lambda e: e IS NOT NULL), '; ')"


def _shown(validated: DataFrame) -> DataFrame:
    shown = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"]))
    return validated.withColumn("errors", F.array_join(shown, "; "))


# Field names and messages of the rules, with their conditions in SQL.
_RUN_CHECKS = [
    ("phase", "Incorrect phase", "phase IS NULL OR phase = ''"),
    ("threads", "Incorrect number of threads", "threads <= 0"),
    ("bulkCount", "Bulk count must be greater than 1", "bulkCount < 1"),
    ("recordCount", "Record count must be greater than 1", "recordCount IS NULL OR recordCount < 1"),
    ("operationCount", "Operation count must be greater than 1", "operationCount < 1"),
    ("readProportion", "Read proportion must be a fraction of 1 or 0", "readProportion > 1"),
    ("updateProportion", "Update proportion must be a fraction of 1 or 0", "updateProportion > 1"),
    ("scanProportion", "Scan proportion must be a fraction of 1 or 0", "scanProportion IS NULL OR scanProportion > 1"),
    ("insertProportion", "Insert proportion must be a fraction of 1 or 0", "insertProportion > 1"),
]


@bound(
    "val1_run_form",
    f"WITH {RUN_FORMS}, v AS (SELECT p_partkey, {_errors_sql(_RUN_CHECKS)} AS errors FROM run_forms) SELECT *, errors = '' AS is_valid FROM v",
)
def val1_run_form(spark, sf_dir):
    checked = validate_rows(run_forms(spark, sf_dir), rules("run_test"))
    return _shown(checked).select("p_partkey", "errors", "is_valid")


_CLUSTER_FORMS = f"""{SPECS}, cluster_forms AS (
  SELECT cluster AS clusterName, shards - 1 AS shardNodes, processes - 1 AS processes, disks AS nodeDisks,
    CASE WHEN c_acctbal > 0 THEN 'n1-standard-4' ELSE '' END AS machineType, 'debian' AS image, 'default' AS network,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'disk per process' WHEN 'MACHINERY' THEN 'raid0' WHEN 'HOUSEHOLD' THEN '' END
      AS dataDiskRaid,
    CASE c_nationkey % 4 WHEN 0 THEN 'ext4' WHEN 1 THEN 'xfs' WHEN 2 THEN 'btrfs' ELSE 'zfs' END AS fileSystem,
    c_nationkey AS dataDiskSizeGb, root_disk_gb AS rootDiskSizeGb
  FROM specs)"""

# Field names and messages of the rules, with their conditions in SQL.
_CLUSTER_CHECKS = [
    ("shardNodes", "Incorrect number of shards", "shardNodes < 2"),
    ("processes", "Incorrect number of processes", "processes <= 0"),
    ("machineType", "You must choose the machine type", "machineType = ''"),
    ("dataDiskType", "You must choose the disk type", "dataDiskRaid IS NULL OR dataDiskRaid = ''"),
    (
        "dataDiskType",
        "The number of processes must match the number of disks for standalone disks mode",
        "dataDiskRaid = 'disk per process' AND processes <> nodeDisks",
    ),
    ("fileSystem", "You must choose the data filesystem type", "fileSystem NOT IN ('ext4', 'xfs', 'btrfs')"),
    ("dataDiskSizeGb", "Incorrect data disk size", "dataDiskSizeGb <= 0"),
]


def _cluster_forms(spark, sf_dir) -> DataFrame:
    raid = F.col("c_mktsegment")
    return specs(spark, sf_dir).select(
        F.col("cluster").alias("clusterName"),
        (F.col("shards") - 1).alias("shardNodes"),
        (F.col("processes") - 1).alias("processes"),
        F.col("disks").alias("nodeDisks"),
        F.when(F.col("c_acctbal") > 0, "n1-standard-4").otherwise("").alias("machineType"),
        F.lit("debian").alias("image"),
        F.lit("default").alias("network"),
        F.when(raid == "BUILDING", "disk per process").when(raid == "MACHINERY", "raid0").when(raid == "HOUSEHOLD", "").alias("dataDiskRaid"),
        F.element_at(F.array(F.lit("ext4"), F.lit("xfs"), F.lit("btrfs"), F.lit("zfs")), F.col("c_nationkey") % 4 + 1).alias("fileSystem"),
        F.col("c_nationkey").alias("dataDiskSizeGb"),
        F.col("root_disk_gb").alias("rootDiskSizeGb"),
    )


@bound(
    "val1_cluster_form",
    f"""WITH {_CLUSTER_FORMS}, v AS (SELECT clusterName, {_errors_sql(_CLUSTER_CHECKS)} AS errors FROM cluster_forms)
    SELECT *, errors = '' AS is_valid FROM v""",
)
def val1_cluster_form(spark, sf_dir):
    checked = validate_rows(_cluster_forms(spark, sf_dir), rules("create_cluster"))
    return _shown(checked).select("clusterName", "errors", "is_valid")


# Field names and messages of the rules, with their conditions in SQL.
_TEST_CHECKS = [
    ("testNodes", "Incorrect number of shards", "testNodes < 1"),
    ("machineType", "You must choose the machine type", "machineType IS NULL OR machineType = ''"),
    ("image", "You must choose an OS image", "image = ''"),
    ("rootDiskSizeGb", "Incorrect OS disk size", "rootDiskSizeGb <= 0"),
]


@bound(
    "val1_test_node_form",
    f"""WITH forms AS (
      SELECT s_suppkey, s_nationkey % 4 AS testNodes, CASE WHEN s_acctbal > 1000 THEN 'n1-standard-4' END AS machineType,
        CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE 'debian' END AS image, s_nationkey - 10 AS rootDiskSizeGb FROM supplier),
    v AS (SELECT s_suppkey, {_errors_sql(_TEST_CHECKS)} AS errors FROM forms) SELECT *, errors = '' AS is_valid FROM v""",
)
def val1_test_node_form(spark, sf_dir):
    forms = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        (F.col("s_nationkey") % 4).alias("testNodes"),
        F.when(F.col("s_acctbal") > 1000, "n1-standard-4").alias("machineType"),
        F.when(F.col("s_nationkey") % 5 == 0, "").otherwise("debian").alias("image"),
        (F.col("s_nationkey") - 10).alias("rootDiskSizeGb"),
    )
    return _shown(validate_rows(forms, rules("create_test_nodes"))).select("s_suppkey", "errors", "is_valid")


@bound(
    "val2_error_report",
    "WITH "
    + RUN_FORMS
    + ", e AS ("
    + " UNION ALL ".join(
        f"SELECT '{field}' AS field, '{message}' AS message FROM run_forms WHERE {broken}" for field, message, broken in _RUN_CHECKS
    )
    + ") SELECT field, string_agg(DISTINCT message, '; ') AS messages, count(*) AS n FROM e GROUP BY field",
)
def val2_error_report(spark, sf_dir):
    report = error_report(validate_rows(run_forms(spark, sf_dir), rules("run_test")))
    return report.withColumn("messages", F.array_join("messages", "; "))
