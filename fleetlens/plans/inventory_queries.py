"""Bound queries of the inventory, lookup and set operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import block
from fleetlens.functions.text import URL_PATTERN
from fleetlens.operators.inventory import (
    INVENTORY_COLUMNS,
    TEST_TEARDOWN,
    any_running,
    classify_nodes,
    endpoint_columns,
    explode_instances,
    first_network,
    first_public_address,
    inventory_view,
    node_addresses,
    node_liveness,
    node_names,
    option_list,
    role_counts,
    teardown_order,
    union_listings,
    with_all_tags,
)
from fleetlens.operators.lookups import (
    existing_nodes,
    lookup_or_null,
    missing_nodes,
    resolve_links,
    resolve_links_array,
)
from fleetlens.operators.nested import find_values
from fleetlens.operators.planning import cluster_plan
from fleetlens.plans.registry import bound
from fleetlens.plans.updates import last_updates
from fleetlens.plans.views import EXISTING, INSTANCES, NODE_LINES, PLAN, existing, instances, node_lines, specs, table, text
from fleetlens.session import scratch_folder
from fleetlens.sources.files import file_digests
from fleetlens.sources.inventory import read_inventory
from fleetlens.sources.listing_blocks import read_large_inventory
from fleetlens.streaming.operations import (
    liveness_table,
    node_liveness_stream,
    role_count_table,
    role_counts_stream,
    start_role_counts,
)
from fleetlens.streaming.partials import start_partials

PAGE = 500


def _write_listings(df: DataFrame, kind: str, fields: list, folder: str) -> None:
    """Writes rows (``c_custkey``, ``id``) as listings of one page of ids each."""
    entry = F.struct("id", F.struct(*fields))
    pages = df.groupBy(block(F.col("c_custkey"), PAGE)).agg(F.map_from_entries(F.collect_list(entry)).alias(kind))
    pages.select(F.to_json(F.struct(kind)).alias("value")).write.text(folder)


_DISKS = """SELECT id, name || '-disk' || i AS disk_name, i, i = 0 AS boot, status, name
FROM instances, LATERAL (SELECT unnest(generate_series(0, n_disks - 1)) AS i)"""
_ADDRESS = "'10.' || i || '.' || (c_custkey // 256) || '.' || (c_custkey % 256)"
_INTERFACES = f"""SELECT id, name, c_custkey, tags, 'eth' || i AS interface, network, {_ADDRESS} AS address, i
FROM instances, LATERAL (SELECT unnest(generate_series(0, n_interfaces - 1)) AS i)"""


@bound(
    "src3_read_inventory",
    f"""WITH {INSTANCES} SELECT id, name, type, status, coalesce(array_to_string(tags, ','), '-') AS tags,
      CAST(n_disks AS INTEGER) AS n_disks, {_ADDRESS.replace("|| i ||", "|| 0 ||")} AS first_address
    FROM instances WHERE n_interfaces > 0
    UNION ALL SELECT id, name, type, status, coalesce(array_to_string(tags, ','), '-'), CAST(n_disks AS INTEGER), NULL
    FROM instances WHERE n_interfaces = 0""",
)
def src3_read_inventory(spark, sf_dir):
    folder = scratch_folder(spark, "instances")
    fields = ["name", "description", "type", "status", "disks", F.col("network_interfaces").alias("network-interfaces"), "tags"]
    _write_listings(instances(spark, sf_dir), "instances", fields, folder)
    read = read_inventory(spark, folder, "instances")
    first = F.try_element_at(F.col("`network-interfaces`"), F.lit("eth0"))["address"]
    return read.select(
        "id",
        "name",
        "type",
        "status",
        F.coalesce(F.array_join("tags", ","), F.lit("-")).alias("tags"),
        F.size("disks").alias("n_disks"),
        first.alias("first_address"),
    )


@bound(
    "prj6_inventory_view",
    f"""WITH {INSTANCES}, d AS ({_DISKS})
    SELECT id || '-' || i AS id, disk_name AS name, 'disk of ' || name AS description, CAST(10 + i AS BIGINT) AS size_gb,
      status, CASE WHEN boot THEN 'pd-standard' ELSE 'pd-ssd' END AS type FROM d""",
)
def prj6_inventory_view(spark, sf_dir):
    """Disk listings, written page by page, read and shown with their published columns."""
    folder = scratch_folder(spark, "disks")
    owned = instances(spark, sf_dir).select("c_custkey", "id", F.col("name").alias("owner"), "status", F.explode("disks").alias("i", "d"))
    disks = owned.withColumn("id", F.concat_ws("-", "id", "i"))
    fields = [
        F.col("d.name").alias("name"),
        F.concat(F.lit("disk of "), F.col("owner")).alias("description"),
        (F.col("i").cast("long") + 10).alias("sizeGb"),
        F.col("status"),
        F.when(F.col("d.boot"), "pd-standard").otherwise("pd-ssd").alias("type"),
    ]
    _write_listings(disks, "disks", fields, folder)
    return inventory_view(read_inventory(spark, folder, "disks"), "disks")


# Lines of a file that is digested.
_LINES = 1000


@bound(
    "src4_file_digests",
    f"""WITH {NODE_LINES}, texts AS (
      SELECT node, seq // {_LINES} AS part, string_agg(line || chr(10), '' ORDER BY seq) AS text FROM node_lines GROUP BY ALL)
    SELECT 'part=' || part AS folder, strlen(text) AS length, regexp_replace(md5(text), '^0+(.)', '\\1') AS digest
    FROM texts""",
)
def src4_file_digests(spark, sf_dir):
    """The node output files, so many lines a file."""
    folder = scratch_folder(spark, "digested")
    lines = node_lines(spark, sf_dir).withColumn("part", block(F.col("seq"), _LINES))
    dealt = lines.repartition("node", "part").sortWithinPartitions("node", "part", "seq")
    dealt.select("node", "part", "line").write.partitionBy("node", "part").text(folder)
    return file_digests(spark, f"{folder}/*/*/*.txt").select("folder", "length", "digest")


# What the supplied tables give for the kinds of listings that are neither instances nor disks.
_KINDS = {
    "diskTypes": ("part", "p_partkey", {"name": "p_name", "description": "p_brand", "validDiskSize": "p_type"}),
    "images": ("supplier", "s_suppkey", {"name": "s_name", "description": None, "status": "s_name"}),
    "networks": ("region", "r_regionkey", {"name": "r_name", "description": "r_name", "ip4Range": None, "ip4Gateway": "r_name"}),
    "zones": ("nation", "n_nationkey", {"name": "n_name", "description": None, "region": "n_regionkey", "status": "n_name"}),
    "machinetypes": ("part", "p_partkey", {"name": "p_name", "description": "p_type", "cpus": "p_size", "memoryMb": "p_partkey"}),
}
_NUMBERS = {"cpus": "int", "memoryMb": "int"}


def _listing(kind: str) -> None:
    source, key, fields = _KINDS[kind]
    published = INVENTORY_COLUMNS[kind]
    kinds = {"int": "INTEGER", "string": "VARCHAR"}
    columns = ", ".join(
        f"CAST({value or 'NULL'} AS {kinds[_NUMBERS.get(name, 'string')]}) AS {published[name]}" for name, value in fields.items())

    @bound(f"src3_{kind.lower()}_listing", f"SELECT CAST({key} AS VARCHAR) AS id, {columns} FROM {source}")
    def query(spark, sf_dir):
        folder = scratch_folder(spark, kind)
        objects = table(spark, sf_dir, source).withColumn("id", F.col(key).cast("string"))
        written = [
            (F.col(value) if value else F.lit(None)).cast(_NUMBERS.get(name, "string")).alias(name)
            for name, value in fields.items()
        ]
        _write_listings(objects.withColumn("c_custkey", F.col(key)), kind, written, folder)
        return inventory_view(read_inventory(spark, folder, kind), kind)


for _kind in _KINDS:
    _listing(_kind)


@bound(
    "src3_large_listing",
    """SELECT CAST(p_partkey AS VARCHAR) || chr(92) || '"{' AS id, p_name AS name, p_type AS description, CAST(p_size AS INTEGER) AS cpus,
      CAST(p_partkey AS INTEGER) AS memory_mb FROM part""",
)
def src3_large_listing(spark, sf_dir):
    """One listing a file, each read as blocks of 4 KiB."""
    folder = scratch_folder(spark, "large-listing")
    fields = F.struct(
        F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").cast("int").alias("cpus"),
        F.col("p_partkey").cast("int").alias("memoryMb"))
    # the key holds what a reader may mistake for the structure
    key = F.concat(F.lit('"'), text("p_partkey"), F.lit('\\\\\\"{": '))
    entries = table(spark, sf_dir, "part").select(F.concat(key, F.to_json(fields)).alias("value"))

    def listing(batches):
        yield pa.RecordBatch.from_arrays([pa.array(['{"machinetypes": {'])], names=["value"])
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = pc.binary_join_element_wise(pa.scalar("" if first else ","), pc.fill_null(batch.column(0), ""), "")
            rest = pc.binary_join_element_wise(pa.scalar(","), batch.column(0), "")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([lines.slice(0, 1), rest.slice(1)])], names=["value"])
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(["}}"])], names=["value"])

    entries.repartition(4, "value").mapInArrow(listing, "value string").write.text(folder)
    return inventory_view(read_large_inventory(spark, folder, "machinetypes", 4096), "machinetypes")


@bound(
    "find_values",
    """
    WITH RECURSIVE d AS (
      SELECT c_custkey, json_object('id', c_custkey, 'owner', json_object('name', c_name, 'nation', json_object('name', c_nationkey)),
        'disks', json_array(json_object('name', 'd0', 'size', 1),
          json_object('source', json_array(json_object('name', json_object('name', c_name), 'x', NULL)), 'size', c_custkey % 3)),
        'tags', json_array('name', c_mktsegment)) AS doc
      FROM customer),
    walk(c_custkey, path, key, v) AS (
      SELECT c_custkey, '', NULL::VARCHAR, doc FROM d
      UNION ALL
      SELECT w.c_custkey, w.path || '/' || e.key, CASE WHEN json_type(w.v) = 'OBJECT' THEN e.key END, e.value
      FROM walk w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY') AND w.key IS DISTINCT FROM 'name')
    SELECT c_custkey, substr(path, 2) AS path, v ->> '$' AS value FROM walk WHERE key = 'name'
    """,
)
def find_values_of_listings(spark, sf_dir):
    """All names in nested listings, one per customer."""
    def named(*fields):
        return F.struct(*(value.alias(name) for name, value in fields))

    name, key = F.col("c_name"), F.col("c_custkey")
    owner = named(("name", name), ("nation", named(("name", F.col("c_nationkey")))))
    source = F.array(named(("name", named(("name", name))), ("x", F.lit(None).cast("int"))))
    disks = F.array(
        F.to_json(named(("name", F.lit("d0")), ("size", F.lit(1)))),
        F.to_json(named(("source", source), ("size", key % 3)), {"ignoreNullFields": "false"}))
    head = F.to_json(named(("id", key), ("owner", owner)))
    tags = F.to_json(named(("tags", F.array(F.lit("name"), F.col("c_mktsegment")))))
    rows = table(spark, sf_dir, "customer").select(
        key, head.alias("_head"), disks.alias("_disks"), tags.alias("_tags")).withColumn(
        "_head", F.expr("substring(_head, 1, length(_head) - 1)")).select("c_custkey", F.concat(
            "_head", F.lit(',"disks":['), F.array_join("_disks", ","), F.lit("],"), F.substring("_tags", 2, 1 << 20)).alias("listing"))
    return find_values(rows, "listing", "name")


@bound(
    "prj7_endpoint_columns",
    f"""
    WITH p AS (
      SELECT page_id, 'c' || page_id % 7 AS cluster, 'shard-node-' || page_id AS role,
        CASE WHEN page_id % 2 = 0 THEN 'u' || page_id || '@localhost@x' ELSE 'u' || page_id END AS "user",
        CASE WHEN contains(url, '?') THEN regexp_replace(url, '^https?://', '') WHEN contains(url, '#') THEN url || ' x'
          ELSE url END AS address
      FROM pages)
    SELECT page_id, cluster || '-' || role AS server_name, cluster || '-' || role || '.c.fleet.internal' AS internal_host,
      string_split("user", '@')[1] AS user_name,
      CASE WHEN contains(address, '//') THEN address ELSE 'mongodb://' || address END AS address_url,
      regexp_full_match(address, '{URL_PATTERN}') AS address_is_url
    FROM p""",
)
def prj7_endpoint_columns(spark, sf_dir):
    key = text("page_id")
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string")).alias("cluster"),
        F.concat(F.lit("shard-node-"), key).alias("role"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("u"), key, F.lit("@localhost@x"))).otherwise(F.concat(F.lit("u"), key)).alias("user"),
        F.when(url.contains("?"), F.regexp_replace(url, "^https?://", ""))
        .when(url.contains("#"), F.concat(url, F.lit(" x")))
        .otherwise(url)
        .alias("address"),
    )
    return endpoint_columns(rows, "fleet").drop("cluster", "role", "user", "address")


@bound(
    "prj9_instance_disks",
    f"""WITH {INSTANCES}, d AS ({_DISKS})
    SELECT id, name, CAST(i AS VARCHAR) AS disk_index, disk_name, CASE WHEN boot THEN 'PERSISTENT' ELSE 'SCRATCH' END AS disk_type,
      'READ_WRITE' AS mode, boot, status = 'RUNNING' AS autodelete FROM d""",
)
def prj9_instance_disks(spark, sf_dir):
    return explode_instances(instances(spark, sf_dir), "disks")


@bound("prj9_instance_interfaces", f"WITH {INSTANCES}, i AS ({_INTERFACES}) SELECT id, name, interface, network, address FROM i")
def prj9_instance_interfaces(spark, sf_dir):
    return explode_instances(instances(spark, sf_dir), "interfaces")


@bound("prj9_instance_tags", f"WITH {INSTANCES} SELECT id, name, unnest(tags) AS tag FROM instances")
def prj9_instance_tags(spark, sf_dir):
    return explode_instances(instances(spark, sf_dir), "tags")


@bound(
    "prj10_node_addresses",
    f"WITH {INSTANCES}, i AS ({_INTERFACES}) SELECT id, interface, address FROM i WHERE list_contains(tags, 'test')",
)
def prj10_node_addresses(spark, sf_dir):
    return node_addresses(instances(spark, sf_dir), ["test"])


@bound("prj10_node_names", f"WITH {INSTANCES} SELECT id, name FROM instances WHERE list_contains(tags, 'shard')")
def prj10_node_names(spark, sf_dir):
    return node_names(instances(spark, sf_dir), ["shard"])


@bound(
    "prj11_first_public_address",
    f"""WITH {INSTANCES}, i AS ({_INTERFACES})
    SELECT n.id, min(CASE WHEN i.i = 0 THEN i.network END) AS network,
      '8.' || arg_min(i.address, i.i) FILTER (NOT (i.i = 0 AND i.c_custkey % 2 = 0) AND i.c_custkey % 5 <> 0) AS public_address
    FROM instances n LEFT JOIN i ON i.id = n.id GROUP BY n.id""",
)
def prj11_first_public_address(spark, sf_dir):
    found = first_network(first_public_address(instances(spark, sf_dir).select("id", "interfaces")))
    return found.select("id", "network", "public_address")


@bound(
    "flt1_with_all_tags",
    f"""WITH {INSTANCES} SELECT id, name FROM instances
    WHERE list_contains(tags, 'shard') AND list_contains(tags, 'NATION_3')""",
)
def flt1_with_all_tags(spark, sf_dir):
    return with_all_tags(instances(spark, sf_dir), "tags", ["shard", "NATION_3"]).select("id", "name")


@bound(
    "flt2_classify_nodes",
    f"""WITH {EXISTING} SELECT o_orderkey, instance,
      CASE WHEN regexp_full_match(instance, cluster || '-conf-node-[0-9]+') THEN 'conf'
        WHEN regexp_full_match(instance, cluster || '-shard-node-[0-9]+') THEN 'shard' END AS role
    FROM existing""",
)
def flt2_classify_nodes(spark, sf_dir):
    return classify_nodes(existing(spark, sf_dir), "instance", F.col("cluster")).drop("cluster")


_COUNTED = ", ".join(
    f"({2 * i}, '{name} nodes', '{tag}', false), ({2 * i + 1}, 'Running {name.lower()} nodes', '{tag}', true)"
    for i, (name, tag) in enumerate((("Shard", "shard"), ("Config", "config"), ("Puppet", "puppet")))
)


@bound(
    "agg1_role_counts",
    f"""WITH {INSTANCES}, charted(position, label, tag, running) AS (VALUES {_COUNTED})
    SELECT position, label, count(id) AS value FROM charted LEFT JOIN instances
      ON list_contains(tags, tag) AND (NOT running OR status = 'RUNNING')
    GROUP BY position, label""",
)
def agg1_role_counts(spark, sf_dir):
    return role_counts(instances(spark, sf_dir))


_POLLED = f"""{INSTANCES}, polled AS (
  SELECT o_orderkey % 8 AS poll_id, tags, CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE status END AS status
  FROM orders JOIN instances ON o_custkey = c_custkey),
charted(position, label, tag, running) AS (VALUES {_COUNTED})"""


_ROLE_COUNTS = f"""WITH {_POLLED}
    SELECT p.poll_id, position, label, count(*) FILTER (list_contains(tags, tag) AND (NOT running OR status = 'RUNNING')) AS value
    FROM polled p, charted GROUP BY p.poll_id, position, label"""


@bound("str4_role_counts_stream", _ROLE_COUNTS)
def str4_role_counts_stream(spark, sf_dir):
    """Counts of every poll, whose instances arrive in several batches."""
    feed, polled = _polled_instances(spark, sf_dir)
    counts = role_count_table(spark, scratch_folder(spark, "role-counts"))
    start_role_counts(_in_batches(spark, feed, polled), counts, scratch_folder(spark, "role-counts-state")).awaitTermination()
    return counts.read()


def _polled_instances(spark, sf_dir):
    feed = scratch_folder(spark, "polled")
    seen = table(spark, sf_dir, "orders").join(instances(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise(F.col("status"))
    poll = F.col("o_orderkey") % 8
    # 2024-01-01 and 4 seconds a poll
    instant = F.timestamp_millis(F.lit(1_704_067_200_000) + poll * 4000)
    polled = seen.select(poll.alias("poll_id"), instant.alias("instant"), "tags", status.alias("status"))
    polled.repartition(6).write.parquet(feed)
    return feed, polled


def _in_batches(spark, feed: str, rows: DataFrame) -> DataFrame:
    """A stream of two files a batch."""
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(feed)


@bound("str4_role_counts_updates", _ROLE_COUNTS)
def str4_role_counts_updates(spark, sf_dir):
    """Update mode with an instant per poll: what the last update of each count says."""
    feed, polled = _polled_instances(spark, sf_dir)
    counts = role_counts_stream(_in_batches(spark, feed, polled), "instant")
    return last_updates(spark, "role-updates", counts, ["poll_id", "position", "label"]).drop("instant")


_STATES = "states AS (SELECT 'node-' || user_id AS node, ts, event_id, event_type <> 'error' AS alive FROM events)"


def _states(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("node-"), text("user_id")).alias("node"), "ts", "event_id", (F.col("event_type") != "error").alias("alive")
    )


@bound(
    "agg4_node_liveness",
    f"WITH {_STATES} SELECT node, alive FROM states QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id DESC) = 1",
)
def agg4_node_liveness(spark, sf_dir):
    return node_liveness(_states(spark, sf_dir), ["ts", "event_id"]).orderBy("node")


_LIVENESS = f"WITH {_STATES} SELECT node, alive FROM states QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id DESC) = 1"


def _states_in_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    feed, states = scratch_folder(spark, "states"), _states(spark, sf_dir)
    states.repartition(6, "event_id").write.parquet(feed)
    return states, _in_batches(spark, feed, states)


@bound("agg4_node_liveness_stream", _LIVENESS)
def agg4_node_liveness_stream(spark, sf_dir):
    """States arrive in batches, in no order of time."""
    states, arriving = _states_in_batches(spark, sf_dir)
    latest = liveness_table(spark, scratch_folder(spark, "liveness"), states.schema, ["ts", "event_id"])
    start_partials(arriving, latest, scratch_folder(spark, "liveness-state")).awaitTermination()
    return latest.read().select("node", "alive")


@bound("agg4_node_liveness_updates", _LIVENESS)
def agg4_node_liveness_updates(spark, sf_dir):
    _, arriving = _states_in_batches(spark, sf_dir)
    return last_updates(spark, "alive", node_liveness_stream(arriving, ["ts", "event_id"]), ["node"])


@bound(
    "agg4_any_running",
    f"""WITH {_STATES}, latest AS (
      SELECT node, alive FROM states QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id DESC) = 1)
    SELECT bool_or(alive) AS any_running FROM latest""",
)
def agg4_any_running(spark, sf_dir):
    return any_running(_states(spark, sf_dir), ["ts", "event_id"])


# Every supplier is listed twice; the first entry has the link that counts.
_LOOKUP = """lookup AS (
  SELECT s_name AS name, 'https://c/first/' || s_suppkey AS link, s_suppkey AS listing_pos FROM supplier
  UNION ALL SELECT s_name, 'https://c/second/' || s_suppkey, s_suppkey + (SELECT count(*) FROM supplier) FROM supplier),
first_link AS (SELECT name, arg_min(link, listing_pos) AS link FROM lookup GROUP BY name)"""


def _lookup(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    listed = suppliers.agg(F.count("*")).scalar()

    def entries(kind: str, pos) -> DataFrame:
        link = F.concat(F.lit(f"https://c/{kind}/"), text("s_suppkey"))
        return suppliers.select(F.col("s_name").alias("name"), link.alias("link"), pos.alias("listing_pos"))

    return union_listings([entries("first", F.col("s_suppkey")), None, entries("second", F.col("s_suppkey") + listed)])


_WANTED = """wanted AS (
  SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN printf('Supplier#%09d', l_suppkey)
    WHEN 'R' THEN printf('Supplier#%09d', l_partkey) END AS name FROM lineitem)"""


def _wanted(spark, sf_dir) -> DataFrame:
    def supplier(key):
        return F.concat(F.lit("Supplier#"), F.lpad(text(key), 9, "0"))

    name = F.when(F.col("l_returnflag") == "A", supplier("l_suppkey")).when(F.col("l_returnflag") == "R", supplier("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", name.alias("name"))


@bound(
    "jon1_resolve_links",
    f"""WITH {_LOOKUP}, {_WANTED}
    SELECT l_orderkey, coalesce(link, w.name) AS name FROM wanted w LEFT JOIN first_link f ON f.name = w.name""",
)
def jon1_resolve_links(spark, sf_dir):
    return resolve_links(_wanted(spark, sf_dir), "name", _lookup(spark, sf_dir))


@bound(
    "jon2_resolve_links_array",
    f"""WITH {_LOOKUP}, elements AS (
      SELECT o_orderkey, unnest([1, 2, 3]) AS i, printf('Supplier#%09d', unnest([o_custkey, o_orderkey, o_custkey // 10])) AS name
      FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')),
    resolved AS (
      SELECT o_orderkey, string_agg(coalesce(link, e.name), '|' ORDER BY i) AS names
      FROM elements e LEFT JOIN first_link f ON f.name = e.name GROUP BY o_orderkey)
    SELECT o.o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE names END AS names
    FROM orders o LEFT JOIN resolved r ON r.o_orderkey = o.o_orderkey""",
)
def jon2_resolve_links_array(spark, sf_dir):
    """Three names in each order's list, none in some, and no list in others."""

    def supplier(key):
        return F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))

    names = F.array(supplier(F.col("o_custkey")), supplier(F.col("o_orderkey")), supplier(block(F.col("o_custkey"), 10)))
    names = F.when(F.col("o_orderpriority") == "5-LOW", F.slice(names, 1, 0)).otherwise(names)
    lists = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "2-HIGH", names).alias("names")
    )
    resolved = resolve_links_array(lists, "names", _lookup(spark, sf_dir))
    return resolved.withColumn("names", F.array_join("names", "|"))


@bound(
    "jon2_resolve_links_of_repeated_rows",
    f"""WITH {_LOOKUP}, elements AS (
      SELECT o_orderkey, unnest([1, 2]) AS i, printf('Supplier#%09d', unnest([o_custkey, o_custkey // 10])) AS name FROM orders),
    resolved AS (
      SELECT o_orderkey, string_agg(coalesce(link, e.name), '|' ORDER BY i) AS names
      FROM elements e LEFT JOIN first_link f ON f.name = e.name GROUP BY o_orderkey)
    SELECT CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderkey % 3 END AS key, names
    FROM orders o JOIN resolved r ON r.o_orderkey = o.o_orderkey""",
)
def jon2_resolve_links_of_repeated_rows(spark, sf_dir):
    """Rows whose key is one of two, or NULL: every row keeps its own list."""
    names = F.array(*(
        F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))
        for key in (F.col("o_custkey"), block(F.col("o_custkey"), 10))))
    key = F.col("o_orderkey") % 3
    lists = table(spark, sf_dir, "orders").select(F.when(key != 0, key).alias("key"), names.alias("names"))
    resolved = resolve_links_array(lists, "names", _lookup(spark, sf_dir))
    return resolved.withColumn("names", F.array_join("names", "|"))


def _planned(spark, sf_dir) -> DataFrame:
    plan = cluster_plan(specs(spark, sf_dir))
    return plan.filter(F.col("disk").endswith("-disk-root")).select("cluster", "role", "instance")


@bound(
    "jon3_missing_nodes",
    f"WITH {PLAN}, {EXISTING} SELECT instance, cluster, role FROM planned_nodes WHERE instance NOT IN (SELECT instance FROM existing)",
)
def jon3_missing_nodes(spark, sf_dir):
    return missing_nodes(_planned(spark, sf_dir), existing(spark, sf_dir))


@bound(
    "jon4_existing_nodes",
    f"WITH {PLAN}, {EXISTING} SELECT instance, cluster, role FROM planned_nodes WHERE instance IN (SELECT instance FROM existing)",
)
def jon4_existing_nodes(spark, sf_dir):
    return existing_nodes(_planned(spark, sf_dir), existing(spark, sf_dir))


@bound(
    "jon4_lookup_or_null",
    f"""WITH {_WANTED} SELECT name, l_orderkey, s_suppkey FROM wanted LEFT JOIN supplier ON s_name = name""",
)
def jon4_lookup_or_null(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return lookup_or_null(_wanted(spark, sf_dir), suppliers, "name")


@bound(
    "set1_union_listings",
    f"""WITH {_LOOKUP} SELECT name, link, listing_pos FROM lookup""",
)
def set1_union_listings(spark, sf_dir):
    return _lookup(spark, sf_dir)


@bound(
    "set2_teardown_order",
    f"""WITH {INSTANCES}, roles(rank, role, tag) AS (VALUES (1, 'shard', 'shard'), (2, 'conf', 'config'), (3, 'puppet', 'puppet'))
    SELECT rank, role, name FROM instances JOIN roles ON list_contains(tags, tag) WHERE list_contains(tags, 'NATION_7')""",
)
def set2_teardown_order(spark, sf_dir):
    return teardown_order(instances(spark, sf_dir), "NATION_7").select("rank", "role", "name")


@bound(
    "set2_test_teardown_order",
    f"""WITH {INSTANCES} SELECT 1 AS rank, 'test' AS role, name FROM instances
    WHERE list_contains(tags, 'test') AND list_contains(tags, network)""",
)
def set2_test_teardown_order(spark, sf_dir):
    """All clusters at once: an instance's own network names its cluster."""
    ours = first_network(instances(spark, sf_dir)).withColumn("cluster", F.element_at("tags", 2))
    return teardown_order(ours, F.col("cluster"), TEST_TEARDOWN).select("rank", "role", "name")


def _options_sql(order_and_default: str) -> str:
    return f"""WITH names AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY p_name)
    SELECT name, {order_and_default} AS is_default FROM names"""


@bound("srt2_options_by_value", _options_sql("name = 'red widget'"))
def srt2_options_by_value(spark, sf_dir):
    return option_list(table(spark, sf_dir, "part"), "p_name", "p_partkey", default="red widget")


@bound("srt2_options_by_prefix", _options_sql("pos = (SELECT min(p_partkey) FROM part WHERE p_name LIKE 'blue%')"))
def srt2_options_by_prefix(spark, sf_dir):
    return option_list(table(spark, sf_dir, "part"), "p_name", "p_partkey", descending=True, default_prefix="blue")


@bound("srt2_options_first_listed", _options_sql("pos = (SELECT min(p_partkey) FROM part)"))
def srt2_options_first_listed(spark, sf_dir):
    return option_list(table(spark, sf_dir, "part"), "p_name", "p_partkey", descending=True, default_first=True)
