"""Planning tables: a specification row expands to nodes, disks, ports and key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import block
from fleetlens.functions.roles import CONFIG_NODES, CONFIG_PORT, ROLE_NAME, ROLE_TAG, SHARD_BASE_PORT

# Where the data disks of a shard node are mounted, and where a process logs.
MOUNT_ROOT = "/mnt/mongodb"
LOG_PREFIX = "/tmp/mongodb-shard-"


def _upto(n: Column) -> Column:
    """1..n, nothing where n is below 1 or NULL."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int")))


def shard_endpoints(nodes: DataFrame, processes: str = "processes", base: int = SHARD_BASE_PORT) -> DataFrame:
    """Every shard node (``node``) with each of its process ports."""
    ports = F.transform(_upto(F.col(processes)), lambda i: F.lit(base) + i - 1)
    return nodes.withColumn("port", F.explode(ports)).withColumn(
        "endpoint", F.concat("node", F.lit(":"), F.col("port").cast("string"))
    )


def config_string(nodes: DataFrame, port: int = CONFIG_PORT) -> DataFrame:
    """``cluster``, ``config_db``: ``host:port`` of the configuration nodes in listing order, joined by commas.

    ``nodes``: ``cluster``, ``node``, ``listing_pos``. A cluster has a fixed, small number of them.
    """
    entry = F.struct("listing_pos", F.concat(F.col("node"), F.lit(f":{port}")).alias("host"))
    ordered = F.array_sort(F.collect_list(entry))
    return nodes.groupBy("cluster").agg(
        F.array_join(F.transform(ordered, lambda e: e["host"]), ",").alias("config_db")
    )


def key_ranges(runs: DataFrame, record_count: str = "record_count", nodes: str = "nodes") -> DataFrame:
    """The key range of each test node of a run: ``node``, ``start_key``, ``end_key`` (exclusive), ``unowned``.

    Every node gets the same whole number of records; what is left over (``unowned``, per run) belongs to
    no node.
    """
    per_node = block(F.col(record_count).cast("long"), F.col(nodes))
    return (
        runs.withColumn("node", F.explode(_upto(F.col(nodes))))
        .withColumn("start_key", per_node * (F.col("node") - 1))
        .withColumn("end_key", per_node * F.col("node"))
        .withColumn("unowned", F.col(record_count).cast("long") - per_node * F.col(nodes))
    )


def assign_key_range(df: DataFrame, key: str, record_count: int | Column, nodes: int) -> DataFrame:
    """Adds ``node``, the owner of each key from 0 on; NULL for keys that belong to no node. Arithmetic only."""
    total = record_count if isinstance(record_count, Column) else F.lit(record_count)
    per_node = block(total.cast("long"), nodes)
    owned = (F.col(key) >= 0) & (F.col(key) < per_node * nodes)
    return df.withColumn("node", F.when(owned, block(F.col(key), F.nullif(per_node, F.lit(0))) + 1))


def cluster_plan(specs: DataFrame) -> DataFrame:
    """Every instance and disk that a cluster specification asks for.

    ``specs``: ``cluster``, ``shards``, ``disks``, ``test_nodes``, ``data_disk_gb``, ``root_disk_gb``. Gives
    ``cluster``, ``role``, ``instance``, ``tags``, ``disk``, ``size_gb``: a root disk for each instance, and
    the data disks of the shard nodes.
    """

    def nodes(role: str, count: Column | None) -> Column:
        base = F.concat(F.col("cluster"), F.lit(f"-{ROLE_NAME[role]}"))
        tags = F.array(F.lit(ROLE_TAG[role]), F.col("cluster"))

        def node(instance: Column) -> Column:
            return F.struct(F.lit(role).alias("role"), instance.alias("instance"), tags.alias("tags"))

        if count is None:
            return F.array(node(base))
        return F.transform(
            F.coalesce(_upto(count), F.array().cast("array<int>")),
            lambda i: node(F.concat(base, F.lit("-node-"), i.cast("string"))),
        )

    everything = F.concat(
        nodes("puppet", None),
        nodes("conf", F.lit(CONFIG_NODES)),
        nodes("shard", F.col("shards")),
        nodes("test-jump", None),
        nodes("test", F.col("test_nodes")),
    )

    def disk(suffix: Column, size: str) -> Column:
        name = F.concat(F.col("instance"), F.lit("-disk"), suffix)
        return F.struct(name.alias("disk"), F.col(size).cast("long").alias("size_gb"))

    root = F.array(disk(F.lit("-root"), "root_disk_gb"))
    data = F.transform(_upto(F.col("disks")), lambda d: disk(d.cast("string"), "data_disk_gb"))
    disks = F.when((F.col("role") == "shard") & (F.col("disks") >= 1), F.concat(root, data)).otherwise(root)
    return specs.select("*", F.inline(everything)).select("cluster", "role", "instance", "tags", F.inline(disks))


def microshard_layout(hosts: DataFrame, base: int = SHARD_BASE_PORT) -> DataFrame:
    """One row per database process of a host: its port, resource share, data directory and log.

    ``hosts``: ``host``, ``mem_total_kb``, ``cores``, ``processes``, ``raid_type``, ``fs_type``, ``dirs``.
    """
    n = F.col("processes")
    process = F.col("process").cast("string")
    memory = block(block(F.col("mem_total_kb"), 1024) - 1, n) * F.lit(1024 * 1024)
    dirs = F.sort_array("dirs")

    def directory(i: Column | int) -> Column:
        return F.coalesce(F.try_element_at(dirs, i if isinstance(i, Column) else F.lit(i)), F.lit(""))

    pooled = F.when(F.col("fs_type") == "btrfs", directory(1)).otherwise(F.lit("md0"))
    path = F.when(F.col("raid_type") == "raid0", F.concat(pooled, F.lit("/"), process)).otherwise(
        directory(F.col("process"))
    )
    return hosts.withColumn("process", F.explode(_upto(n))).select(
        "host",
        "process",
        (F.lit(base) + F.col("process") - 1).alias("port"),
        memory.alias("memory_bytes"),
        F.greatest(F.lit(1).cast("long"), block(F.lit(1024), n)).alias("cpu_shares"),
        F.concat(F.lit("0-"), (F.col("cores") - 1).cast("string")).alias("cpus"),
        F.concat(F.lit(f"{MOUNT_ROOT}/"), path).alias("data_dir"),
        F.concat(F.lit(LOG_PREFIX), process, F.lit(".log")).alias("log_path"),
    )
