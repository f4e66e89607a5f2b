"""Inventory, lookups and sets."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.inventory import (
    INVENTORY_COLUMNS,
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
from fleetlens.session import scratch_folder
from fleetlens.sources.inventory import LISTING_OBJECTS, read_inventory
from fleetlens.operators.nested import find_values
from fleetlens.streaming.operations import role_counts_stream

INSTANCES = {
    "7": {
        "name": "c1-shard-node-1",
        "description": None,
        "type": "n1",
        "status": "RUNNING",
        "disks": {
            "0": {"name": "root", "type": "P", "mode": "RW", "boot": True, "autodelete": True},
            "1": {"name": "d1", "type": "P", "mode": "RW", "boot": False, "autodelete": True},
        },
        "network-interfaces": {"eth0": {"network": "net", "address": "10.0.0.1"}, "eth1": {"network": "b", "address": "10.0.0.2"}},
        "tags": ["shard", "shard", "config", "c1"],
    },
    "8": {"name": "c1-test-node-1", "type": "n1", "status": "STAGING", "disks": {}, "network-interfaces": {}, "tags": ["shard"]},
    "9": {"name": "bare", "status": "RUNNING"},
}


@pytest.fixture(scope="module")
def instances(spark):
    folder = scratch_folder(spark, "listing")
    spark.createDataFrame([(json.dumps({"instances": INSTANCES}),)], "value string").write.text(folder)
    return inventory_view(read_inventory(spark, folder, "instances"), "instances")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_parts_of_instances(instances):
    disks = explode_instances(instances, "disks").orderBy("disk_index").collect()
    assert [(d.id, d.disk_index, d.disk_name, d.boot, d.autodelete) for d in disks] == [
        ("7", "0", "root", True, True),
        ("7", "1", "d1", False, True),
    ]
    interfaces = explode_instances(instances, "interfaces").collect()
    assert sorted((i.interface, i.network, i.address) for i in interfaces) == [("eth0", "net", "10.0.0.1"), ("eth1", "b", "10.0.0.2")]
    assert [(t.id, t.tag) for t in explode_instances(instances, "tags").orderBy("id").collect()][-1] == ("8", "shard")
    with pytest.raises(ValueError):
        explode_instances(instances, "cpus")


def test_pretty_printed_listing(spark):
    folder = scratch_folder(spark, "pretty")
    spark.createDataFrame([(json.dumps({"zones": {"1": {"name": "z", "region": "r", "status": "UP"}}}, indent=2),)], "v string").write.text(folder)
    rows = inventory_view(read_inventory(spark, folder, "zones", multi_line=True), "zones").collect()
    assert [tuple(r) for r in rows] == [("1", "z", None, "r", "UP")]


@pytest.mark.parametrize("kind", list(LISTING_OBJECTS))
def test_every_kind_has_its_published_columns(spark, kind):
    folder = scratch_folder(spark, kind)
    spark.createDataFrame([(json.dumps({kind: {"1": {"name": "x"}}}),)], "v string").write.text(folder)
    view = inventory_view(read_inventory(spark, folder, kind), kind)
    assert view.columns == ["id", *INVENTORY_COLUMNS[kind].values()]
    assert view.first().name == "x"


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        read_inventory(spark, "/nowhere", "buckets")


def test_all_requested_tags(instances):
    assert ids(with_all_tags(instances, "tags", ["shard", "c1"])) == ["7"]
    assert ids(with_all_tags(instances, "tags", ["shard"])) == ["7", "8"]
    assert ids(with_all_tags(instances, "tags", [])) == ids(with_all_tags(instances, "tags", None)) == ["7", "8", "9"]
    assert [r.address for r in node_addresses(instances, ["c1"]).orderBy("address").collect()] == ["10.0.0.1", "10.0.0.2"]
    assert [r.name for r in node_names(instances, ["c1"]).collect()] == ["c1-shard-node-1"]


def test_role_counts_keep_zeros_and_count_an_instance_once_per_role(instances):
    got = [(r.label, r.value) for r in role_counts(instances).orderBy("position").collect()]
    assert got == [
        ("Shard nodes", 2),
        ("Running shard nodes", 1),
        ("Config nodes", 1),
        ("Running config nodes", 1),
        ("Puppet nodes", 0),
        ("Running puppet nodes", 0),
    ]
    assert [r.value for r in role_counts(instances.limit(0)).collect()] == [0] * 6


def test_role_counts_per_poll_as_a_stream(spark):
    folder, out = scratch_folder(spark, "polled"), {}
    schema = "poll_id long, tags array<string>, status string"
    for rows in ([(1, ["shard"], "RUNNING"), (1, ["shard"], "STOPPED")], [(2, ["puppet"], "RUNNING")], [(1, ["config"], "X")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def keep(batch, _):
        out.update({(r.poll_id, r.label): r.value for r in batch.collect()})

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = role_counts_stream(arriving).writeStream.outputMode("update").foreachBatch(keep)
    counts.option("checkpointLocation", scratch_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert out[1, "Shard nodes"] == 2 and out[1, "Running shard nodes"] == 1 and out[1, "Config nodes"] == 1
    assert out[2, "Puppet nodes"] == 1 and out[2, "Shard nodes"] == 0


def test_public_address_is_the_first_there_is(spark):
    interface = "struct<name:string,network:string,address:string,access_configs:array<struct<nat_ip:string>>>"

    def eth(n, configs):
        return (f"eth{n}", f"net{n}", f"10.0.0.{n}", None if configs is None else [(c,) for c in configs])

    rows = [
        (1, [eth(0, None), eth(1, []), eth(2, ["8.8.8.8", "9.9.9.9"]), eth(3, ["7.7.7.7"])]),
        (2, [eth(0, [])]),
        (3, []),
        (4, None),
        (5, [eth(0, [None, "1.1.1.1"])]),
    ]
    df = spark.createDataFrame(rows, f"id int, interfaces array<{interface}>")
    got = first_network(first_public_address(df)).orderBy("id").collect()
    assert [r.public_address for r in got] == ["8.8.8.8", None, None, None, None]
    assert [r.network for r in got] == ["net0", "net0", None, None, "net0"]


def test_classes_of_host_names(spark):
    names = ["c.1-conf-node-1", "c.1-shard-node-12", "cx1-conf-node-1", "c.1-conf-node-", "c.1-conf-node-1a", "c.1-test-node-1", None]
    got = classify_nodes(spark.createDataFrame([(n,) for n in names], "h string"), "h", "c.1").collect()
    assert [r.role for r in got] == ["conf", "shard", None, None, None, None, None]


def test_endpoints(spark):
    rows = [("c", "shard", "a@b@c", "db:1"), ("c", "conf", "root", "mongodb://x"), ("c", "t", "u", "//x"), ("c", "t", None, None)]
    got = endpoint_columns(spark.createDataFrame(rows, "cluster string, role string, user string, address string"), "p").collect()
    assert (got[0].server_name, got[0].internal_host, got[0].user_name) == ("c-shard", "c-shard.c.p.internal", "a")
    assert [r.address_url for r in got] == ["mongodb://db:1", "mongodb://x", "//x", None]
    urls = ["http://a", "https://a/b?c=d", "ftp://x.y", "xhttp://a", "http://", "http://a b", "http://a.", "file://a", "http://a\n"]
    df = spark.createDataFrame([("", "", "", u) for u in urls], "cluster string, role string, user string, address string")
    assert [r.address_is_url for r in endpoint_columns(df, "p").collect()] == [True, True, True] + [False] * 6


def test_liveness(spark):
    states = spark.createDataFrame([("b", 1, True), ("a", 1, True), ("a", 2, False)], "node string, ts long, alive boolean")
    assert [(r.node, r.alive) for r in node_liveness(states, ["ts"]).orderBy("node").collect()] == [("a", False), ("b", True)]
    assert any_running(states, ["ts"]).first()[0] is True
    assert any_running(states.filter("node = 'a'"), ["ts"]).first()[0] is False
    assert any_running(states.limit(0), ["ts"]).first()[0] is False


def test_options(spark):
    rows = [("b", 1), ("debian-7", 2), ("a", 3), ("debian-6", 4), ("debian-7", 5), ("b", 6), (None, 0)]
    df = spark.createDataFrame(rows, "name string, pos long")

    def options(**rule):
        return [(r.name, r.is_default) for r in option_list(df, "name", "pos", **rule).collect()]

    assert options(default="a") == [("a", True), ("b", False), ("debian-6", False), ("debian-7", False)]
    assert options(descending=True, default_prefix="debian-") == [("debian-7", True), ("debian-6", False), ("b", False), ("a", False)]
    assert [n for n, d in options(default_first=True) if d] == ["b"]
    assert not any(d for _, d in options(default_prefix="zzz")) and not any(d for _, d in options())


def test_union_skips_missing_and_keeps_duplicates(spark):
    one = spark.createDataFrame([("x", 1)], "name string, n int")
    assert union_listings([one, None, one.select("n", "name")]).count() == 2
    with pytest.raises(ValueError):
        union_listings([None])


def test_teardown_lists_an_instance_once_per_role(instances):
    got = teardown_order(instances, "c1").orderBy("rank").collect()
    assert [(r.rank, r.role, r.id) for r in got] == [(1, "shard", "7"), (2, "conf", "7")]


LOOKUP = [("n1", "first", 1), ("n1", "second", 2), ("n2", "other", 3), ("first", "trap", 4)]


def test_first_link_of_a_name_wins(spark):
    lookup = spark.createDataFrame(LOOKUP, "name string, link string, listing_pos long").repartition(3)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["n1", "n2", "n3", None, "n1"])], "i int, machine string")
    got = resolve_links(df, "machine", lookup).orderBy("i")
    assert got.columns == ["i", "machine"] and [r.machine for r in got.collect()] == ["first", "other", "n3", None, "first"]


def test_links_in_lists_keep_their_places(spark):
    lookup = spark.createDataFrame(LOOKUP, "name string, link string, listing_pos long")
    rows = [(1, ["n2", "n1", "?", "n1"]), (2, []), (3, None), (4, [None, "n1"])]
    df = spark.createDataFrame(rows, "id int, networks array<string>")
    got = resolve_links_array(df, "networks", lookup).orderBy("id").collect()
    assert [r.networks for r in got] == [["other", "first", "?", "first"], [], None, [None, "first"]]


def test_missing_and_existing_nodes(spark):
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "instance string")
    existing = spark.createDataFrame([("a",), ("a",), ("z",)], "instance string")
    assert sorted(r[0] for r in missing_nodes(planned, existing).collect()) == ["b", "c"]
    assert [r[0] for r in existing_nodes(planned, existing).collect()] == ["a"]
    table = existing.distinct().withColumn("zone", F.lit("z1"))
    got = sorted(map(tuple, lookup_or_null(planned, table, "instance").collect()))
    assert got == [("a", "z1"), ("b", None), ("c", None)]


def test_values_of_a_field_at_any_depth(spark):
    """A value that is found is not searched itself; texts that are no JSON, empty ones and nulls have none."""
    rows = [
        (1, '{"name": "a", "b": {"name": {"name": "inner"}, "c": [1, [{"name": null}, {"x": {"name": true}}]]}}', "k"),
        (2, '[{"name": 1.50}, {"name": [1, 2]}, "name", []]', "k"), (3, "{broken", "k"), (4, None, "k"), (5, "{}", None),
        (6, '"name"', "k"), (7, '{"Name": 1, "name ": 2, "": {"name": ""}}', "k"), (1, '{"name": "a"}', "again"),
    ]
    docs = spark.createDataFrame(rows, "id long, doc string, path string").withColumnRenamed("path", "tree")
    found = find_values(docs, "doc", "name")
    assert found.columns == ["id", "tree", "path", "value"]
    assert sorted(map(tuple, found.drop("tree").collect()), key=repr) == sorted([
        (1, "name", "a"), (1, "b/name", '{"name":"inner"}'), (1, "b/c/1/0/name", None), (1, "b/c/1/1/x/name", "true"),
        (2, "0/name", "1.5"), (2, "1/name", "[1,2]"), (7, "/name", ""), (1, "name", "a"),
    ], key=repr)
    assert find_values(docs.limit(0), "doc", "name").collect() == []


def test_deep_documents_are_taken_apart_level_by_level(spark):
    deep = "".join('{"x":[' for _ in range(40)) + '{"name":7}' + "".join("]}" for _ in range(40))
    docs = spark.createDataFrame([(1, deep)], "id long, doc string")
    assert [(r.path.count("/"), r.value) for r in find_values(docs, "doc", "name").collect()] == [(80, "7")]
