"""The supplied tables dressed as telemetry, polls, inventory and specifications.

Every view covers its whole table. The SQL texts define the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.numbers import block
from fleetlens.functions.times import millis_to_iso, wall_millis

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: str, cases: dict[str, str | None], otherwise: str | None = None) -> Column:
    """``cases[value of key]`` as text."""
    out = F.lit(otherwise).cast("string")
    for value, result in cases.items():
        out = F.when(F.col(key) == value, F.lit(result).cast("string")).otherwise(out)
    return out


def text(value: str) -> Column:
    return F.col(value).cast("string")


# -- load-test output: one line per event, in several right and wrong shapes

NODE_LINES = """
node_lines AS (
  SELECT 'node-' || (event_id % 4) AS node, event_id AS seq,
    CASE event_id % 13
      WHEN 1 THEN ' ' || head || ', ' || user_id
      WHEN 2 THEN head || ', ' || user_id || '.5'
      WHEN 3 THEN head
      WHEN 4 THEN head || ', ' || user_id || ',extra,'
      WHEN 5 THEN head || ', ' || user_id || chr(9)
      ELSE head || ', ' || user_id END AS line
  FROM (
    SELECT event_id, user_id,
      '[' || CASE WHEN event_id % 10 = 0 THEN 'DELETE' WHEN event_type = 'view' THEN 'READ'
        WHEN event_type = 'click' THEN 'SCAN' WHEN event_type = 'purchase' THEN 'INSERT'
        WHEN event_type = 'signup' THEN 'UPDATE' ELSE 'ERROR' END
      || '], ' || (epoch_us(ts) // 1000) || ', ' || CAST(value AS DECIMAL(12, 2)) AS head
    FROM events))
"""

MEASURES = (
    NODE_LINES
    + """,
tokens AS (
  SELECT node, seq, line, trim(line, chr(9) || chr(10) || chr(13) || ' ') AS body,
    list_transform(string_split(trim(line, chr(9) || chr(10) || chr(13) || ' '), ','),
      lambda t: trim(t, chr(9) || chr(10) || chr(13) || ' ')) AS t
  FROM node_lines WHERE line[1] = '[' AND contains(line, ']') AND contains(line, ',')),
measures AS (
  SELECT node, seq, TRY_CAST(t[2] AS BIGINT) AS time, substr(body, 2, strpos(body, ']') - 2) AS op,
    TRY_CAST(t[4] AS INTEGER) AS ops, TRY_CAST(t[3] AS FLOAT) AS avg_latency, line
  FROM tokens
  WHERE len(t) >= 4 AND t[1][1] = '[' AND t[1][-1] = ']'
    AND regexp_full_match(t[4], '[0-9]{1,13}') AND TRY_CAST(t[4] AS INTEGER) IS NOT NULL
    AND regexp_full_match(t[3], '[0-9]{1,13}([.][0-9]+)?') AND regexp_full_match(t[2], '[0-9]{1,13}')
    AND substr(body, 2, strpos(body, ']') - 2) IN ('INSERT', 'UPDATE', 'DELETE', 'SCAN', 'READ'))
"""
)


def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_id") % 10 == 0, F.lit("DELETE")).otherwise(
        choose(
            "event_type", {"view": "READ", "click": "SCAN", "purchase": "INSERT", "signup": "UPDATE"}, otherwise="ERROR"
        )
    )
    latency = F.col("value").cast("decimal(12,2)").cast("string")
    shape = F.col("event_id") % 13
    count = F.when(shape == 3, F.lit("")).otherwise(F.concat(F.lit(", "), text("user_id")))
    tail = F.when(shape == 2, ".5").when(shape == 4, ",extra,").when(shape == 5, "\t").otherwise("")
    line = F.concat(
        F.when(shape == 1, " [").otherwise("["),
        op,
        F.lit("], "),
        wall_millis(F.col("ts")).cast("string"),
        F.lit(", "),
        latency,
        count,
        tail,
    )
    node = F.concat(F.lit("node-"), (F.col("event_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select(node.alias("node"), F.col("event_id").alias("seq"), line.alias("line"))


# -- operations: one per order

OPERATIONS = """
operations AS (
  SELECT o_orderkey, 'op-' || o_orderkey AS name,
    CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'RUNNING' ELSE o_orderstatus END
      AS status,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS insert_time,
    CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') END AS start_time,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') END AS end_time,
    CAST(o_orderkey % 101 AS INTEGER) AS progress, 'user-' || o_custkey AS user,
    o_orderpriority AS optype,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'plain-' || o_custkey
      WHEN o_orderpriority <> '2-HIGH' THEN 'https://c/zones/z/' || o_custkey END AS target_link
  FROM orders)
"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = wall_millis(F.col("o_orderdate"))
    customer = text("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("op-"), text("o_orderkey")).alias("name"),
        F.coalesce(choose("o_orderstatus", {"F": "DONE", "P": "PENDING", "O": "RUNNING"}), "o_orderstatus").alias("status"),
        millis_to_iso(day).alias("insert_time"),
        F.when(F.col("o_orderstatus") != "P", millis_to_iso(day)).alias("start_time"),
        F.when(F.col("o_orderstatus") == "F", millis_to_iso(day + HOUR_MS)).alias("end_time"),
        (F.col("o_orderkey") % 101).cast("int").alias("progress"),
        F.concat(F.lit("user-"), customer).alias("user"),
        F.col("o_orderpriority").alias("optype"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("plain-"), customer))
        .when(F.col("o_orderpriority") != "2-HIGH", F.concat(F.lit("https://c/zones/z/"), customer))
        .alias("target_link"),
    )


# -- polls: each hour a poll sees, for every user with events in that hour, the state of the last one

POLLS = """
polls AS (
  SELECT 'op-' || user_id AS name, poll_id, (poll_id + 1) * 3600000 AS poll_ms,
    CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'signup' THEN 'QUEUED'
      ELSE 'DONE' END AS status,
    CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' AND value < 5 THEN 'n/a'
      ELSE strftime(make_timestamp((ms - (user_id % 5) * 3600000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS start_time,
    strftime(make_timestamp((ms - 7200000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS insert_time
  FROM (
    SELECT *, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 3600000000 AS poll_id,
      row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts DESC, event_id DESC) AS place
    FROM events)
  WHERE place = 1)
"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = wall_millis(F.col("ts"))
    seen = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", block(ms, HOUR_MS).alias("poll_id"))
        .agg(F.max_by(F.struct("event_type", "value", ms.alias("ms")), F.struct("ts", "event_id")).alias("_e"))
        .select("user_id", "poll_id", "_e.*")
    )
    started = millis_to_iso(F.col("ms") - (F.col("user_id") % 5) * HOUR_MS)
    start = (
        F.when(F.col("event_type") == "view", F.lit(None).cast("string"))
        .when((F.col("event_type") == "error") & (F.col("value") < 5), F.lit("n/a"))
        .otherwise(started)
    )
    return seen.select(
        F.concat(F.lit("op-"), text("user_id")).alias("name"),
        "poll_id",
        ((F.col("poll_id") + 1) * HOUR_MS).alias("poll_ms"),
        choose("event_type", {"view": "PENDING", "click": "RUNNING", "signup": "QUEUED"}, otherwise="DONE").alias("status"),
        start.alias("start_time"),
        millis_to_iso(F.col("ms") - 2 * HOUR_MS).alias("insert_time"),
    )


# -- instances: one per customer

INSTANCES = """
instances AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'n1-standard-' || (c_custkey % 4 + 1) AS type,
    CASE WHEN c_acctbal > 0 THEN 'RUNNING' ELSE 'TERMINATED' END AS status, n_name AS network,
    CASE WHEN c_acctbal >= -900 THEN [CASE c_mktsegment WHEN 'BUILDING' THEN 'shard' WHEN 'MACHINERY' THEN 'config'
      WHEN 'HOUSEHOLD' THEN 'puppet' ELSE 'test' END, n_name] END AS tags,
    c_custkey % 3 + 1 AS n_disks, c_custkey % 3 AS n_interfaces
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in listing form, plus ``interfaces``: the ordered interfaces with their access configs."""
    role = choose(
        "c_mktsegment", {"BUILDING": "shard", "MACHINERY": "config", "HOUSEHOLD": "puppet"}, otherwise="test"
    )
    key = F.col("c_custkey")
    index = F.sequence(F.lit(0), (key % 3).cast("int"))

    def disk(i: Column) -> Column:
        return F.struct(
            i.cast("string").alias("key"),
            F.struct(
                F.concat(F.col("c_name"), F.lit("-disk"), i.cast("string")).alias("name"),
                F.when(i == 0, F.lit("PERSISTENT")).otherwise(F.lit("SCRATCH")).alias("type"),
                F.lit("READ_WRITE").alias("mode"),
                (i == 0).alias("boot"),
                (F.col("c_acctbal") > 0).alias("autodelete"),
            ).alias("value"),
        )

    def address(i: Column) -> Column:
        return F.concat_ws(".", F.lit("10"), i.cast("string"), block(key, 256).cast("string"), (key % 256).cast("string"))

    def interface(i: Column) -> Column:
        nat = F.array(F.struct(F.concat(F.lit("8."), address(i)).alias("nat_ip")))
        none = F.lit(None).cast("array<struct<nat_ip:string>>")
        empty = F.array().cast("array<struct<nat_ip:string>>")
        configs = F.when((i == 0) & (key % 2 == 0), none).when(key % 5 == 0, empty).otherwise(nat)
        return F.struct(
            F.concat(F.lit("eth"), i.cast("string")).alias("name"),
            F.col("n_name").alias("network"),
            address(i).alias("address"),
            configs.alias("access_configs"),
        )

    no_interfaces = F.slice(F.transform(index, interface), F.lit(1), (key % 3).cast("int"))
    owners = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return owners.select(
        "c_custkey",
        text("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("n1-standard-"), (key % 4 + 1).cast("string")).alias("type"),
        F.when(F.col("c_acctbal") > 0, F.lit("RUNNING")).otherwise(F.lit("TERMINATED")).alias("status"),
        F.map_from_entries(F.transform(index, disk)).alias("disks"),
        no_interfaces.alias("interfaces"),
        F.when(F.col("c_acctbal") >= -900, F.array(role, F.col("n_name"))).alias("tags"),
    ).withColumn(
        "network_interfaces",
        F.map_from_entries(
            F.transform(
                "interfaces",
                lambda i: F.struct(i["name"], F.struct(i["network"].alias("network"), i["address"].alias("address"))),
            )
        ),
    )


# -- cluster specifications and hosts: one per customer

SPECS = """
specs AS (
  SELECT c_custkey, lower(replace(c_name, '#', '-')) AS cluster, CAST(c_custkey % 4 + 2 AS INTEGER) AS shards,
    c_nationkey % 3 + 1 AS disks, CAST(c_custkey % 5 + 1 AS INTEGER) AS processes, c_nationkey % 4 AS test_nodes,
    100 + c_nationkey AS data_disk_gb, 10 AS root_disk_gb, c_mktsegment, c_nationkey, c_acctbal
  FROM customer)
"""

PLAN = (
    SPECS
    + """,
planned_nodes AS (
  SELECT cluster, 'puppet' AS role, cluster || '-puppetmaster' AS instance, 'puppet' AS tag, 0 AS n, 0 AS disks,
    data_disk_gb, root_disk_gb FROM specs
  UNION ALL SELECT cluster, 'conf', cluster || '-conf-node-' || n, 'config', n, 0, data_disk_gb, root_disk_gb
    FROM specs, generate_series(1, 3) g(n)
  UNION ALL SELECT cluster, 'shard', cluster || '-shard-node-' || n, 'shard', n, disks, data_disk_gb, root_disk_gb
    FROM specs, LATERAL (SELECT unnest(generate_series(1, shards)) AS n)
  UNION ALL SELECT cluster, 'test-jump', cluster || '-test-jump', 'test-jump', 0, 0, data_disk_gb, root_disk_gb FROM specs
  UNION ALL SELECT cluster, 'test', cluster || '-test-node-' || n, 'test', n, 0, data_disk_gb, root_disk_gb
    FROM specs, LATERAL (SELECT unnest(generate_series(1, test_nodes)) AS n))
"""
)

# Nodes that exist: each order names one node of its customer's cluster.
EXISTING = """
existing AS (
  SELECT o_orderkey, lower(printf('customer-%09d', o_custkey)) AS cluster,
    lower(printf('customer-%09d', o_custkey)) || CASE o_orderpriority WHEN '1-URGENT' THEN '-conf-node-'
      WHEN '2-HIGH' THEN '-shard-node-' WHEN '3-MEDIUM' THEN '-conf-node-x' WHEN '4-NOT SPECIFIED' THEN '-shard-node-'
      ELSE '-test-node-' END || (o_orderkey % 6 + 1) AS instance
  FROM orders)
"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("cluster"),
        (key % 4 + 2).cast("int").alias("shards"),
        (F.col("c_nationkey") % 3 + 1).alias("disks"),
        (key % 5 + 1).cast("int").alias("processes"),
        (F.col("c_nationkey") % 4).alias("test_nodes"),
        (F.col("c_nationkey") + 100).alias("data_disk_gb"),
        F.lit(10).alias("root_disk_gb"),
        "c_mktsegment",
        "c_nationkey",
        "c_acctbal",
    )


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.concat(F.lit("customer-"), F.lpad(text("o_custkey"), 9, "0"))
    role = choose(
        "o_orderpriority",
        {
            "1-URGENT": "-conf-node-",
            "2-HIGH": "-shard-node-",
            "3-MEDIUM": "-conf-node-x",
            "4-NOT SPECIFIED": "-shard-node-",
        },
        otherwise="-test-node-",
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cluster.alias("cluster"),
        F.concat(cluster, role, (F.col("o_orderkey") % 6 + 1).cast("string")).alias("instance"),
    )


HOSTS = (
    SPECS
    + """,
hosts AS (
  SELECT cluster AS host, 1000000 + c_custkey * 7919 AS mem_total_kb, c_nationkey % 8 + 1 AS cores, processes,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'raid0' ELSE 'disk per process' END AS raid_type,
    CASE WHEN c_nationkey % 2 = 0 THEN 'btrfs' ELSE 'ext4' END AS fs_type,
    list_transform(generate_series(0, c_custkey % 4), lambda i: 'disk' || (3 - i)) AS dirs
  FROM specs)
"""
)


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark, sf_dir).select(
        F.col("cluster").alias("host"),
        (F.col("c_custkey") * 7919 + 1_000_000).alias("mem_total_kb"),
        (F.col("c_nationkey") % 8 + 1).alias("cores"),
        "processes",
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "raid0").otherwise("disk per process").alias("raid_type"),
        F.when(F.col("c_nationkey") % 2 == 0, "btrfs").otherwise("ext4").alias("fs_type"),
        F.transform(
            F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int")),
            lambda i: F.concat(F.lit("disk"), (3 - i).cast("string")),
        ).alias("dirs"),
    )


# -- forms

RUN_FORMS = """
run_forms AS (
  SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN '' WHEN 'Brand#2' THEN NULL ELSE 'load' END AS phase,
    p_size - 3 AS threads, p_size - 1 AS bulkCount, CASE WHEN p_size <> 7 THEN CAST(p_partkey AS INTEGER) END AS recordCount,
    CAST(p_partkey AS INTEGER) * 10 - 100 AS operationCount,
    CAST((p_retailprice - 900) / 100 AS FLOAT) AS readProportion, CAST(1 - (p_retailprice - 900) / 100 AS FLOAT) AS updateProportion,
    CASE WHEN p_type <> 'SMALL' THEN CAST(0 AS FLOAT) END AS scanProportion, CAST(p_size AS FLOAT) / 40 AS insertProportion
  FROM part)
"""


def run_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.col("p_retailprice") - 900) / 100
    key = F.col("p_partkey").cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#1", "").when(F.col("p_brand") != "Brand#2", "load").alias("phase"),
        (F.col("p_size") - 3).alias("threads"),
        (F.col("p_size") - 1).alias("bulkCount"),
        F.when(F.col("p_size") != 7, key).alias("recordCount"),
        (key * 10 - 100).alias("operationCount"),
        share.cast("float").alias("readProportion"),
        (1 - share).cast("float").alias("updateProportion"),
        F.when(F.col("p_type") != "SMALL", F.lit(0).cast("float")).alias("scanProportion"),
        (F.col("p_size").cast("float") / 40).cast("float").alias("insertProportion"),
    )
