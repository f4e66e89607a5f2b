"""Planning expansions, keys, validation and content."""

import hashlib

import pytest
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


def test_key_ranges_leave_the_remainder_unowned(spark):
    runs = spark.createDataFrame([("r", 10, 3), ("s", 2, 3), ("t", 5, 0)], "run string, record_count int, nodes int")
    got = [(r.run, r.node, r.start_key, r.end_key, r.unowned) for r in key_ranges(runs).orderBy("run", "node").collect()]
    assert got == [("r", 1, 0, 3, 1), ("r", 2, 3, 6, 1), ("r", 3, 6, 9, 1), ("s", 1, 0, 0, 2), ("s", 2, 0, 0, 2), ("s", 3, 0, 0, 2)]


def test_owner_of_a_key(spark):
    keys = spark.range(-1, 11).withColumnRenamed("id", "k")
    got = [r.node for r in assign_key_range(keys, "k", 10, 3).orderBy("k").collect()]
    assert got == [None, 1, 1, 1, 2, 2, 2, 3, 3, 3, None, None]
    assert {r.node for r in assign_key_range(keys, "k", 2, 3).collect()} == {None}


def test_cluster_plan(spark):
    schema = "cluster string, shards int, disks int, test_nodes int, data_disk_gb int, root_disk_gb int"
    rows = cluster_plan(spark.createDataFrame([("c", 2, 2, 1, 200, 10)], schema)).collect()
    by_role = {}
    for r in rows:
        by_role.setdefault(r.role, []).append((r.instance, r.disk, r.size_gb))
        assert r.tags[1] == "c"
    assert by_role["puppet"] == [("c-puppetmaster", "c-puppetmaster-disk-root", 10)]
    assert [i for i, _, _ in by_role["conf"]] == [f"c-conf-node-{i}" for i in (1, 2, 3)]
    assert by_role["shard"][:3] == [
        ("c-shard-node-1", "c-shard-node-1-disk-root", 10),
        ("c-shard-node-1", "c-shard-node-1-disk1", 200),
        ("c-shard-node-1", "c-shard-node-1-disk2", 200),
    ]
    assert len(by_role["shard"]) == 6 and by_role["test-jump"] == [("c-test-jump", "c-test-jump-disk-root", 10)]
    assert by_role["test"] == [("c-test-node-1", "c-test-node-1-disk-root", 10)]
    assert {r.role: r.tags[0] for r in rows} == {
        "puppet": "puppet", "conf": "config", "shard": "shard", "test-jump": "test-jump", "test": "test",
    }
    bare = cluster_plan(spark.createDataFrame([("c", 0, 0, None, 200, 10)], schema)).collect()
    assert [r.role for r in bare] == ["puppet", "conf", "conf", "conf", "test-jump"]


def test_endpoints_and_config_string(spark):
    nodes = spark.createDataFrame([("n1", 2), ("n2", 0)], "node string, processes int")
    assert [r.endpoint for r in shard_endpoints(nodes).orderBy("port").collect()] == ["n1:27040", "n1:27041"]
    conf = spark.createDataFrame([("c", "b", 1), ("c", "a", 2), ("d", "x", 5)], "cluster string, node string, listing_pos int")
    assert dict(map(tuple, config_string(conf).collect())) == {"c": "b:27019,a:27019", "d": "x:27019"}


def test_microshards(spark):
    schema = "host string, mem_total_kb long, cores int, processes int, raid_type string, fs_type string, dirs array<string>"
    rows = [
        ("a", 8_000_000, 4, 3, "raid0", "btrfs", ["sdc", "sdb"]),
        ("b", 8_000_000, 4, 1, "raid0", "ext4", []),
        ("c", 8_000_000, 1, 3, "none", "ext4", ["sdc", "sdb"]),
        ("d", 99_000_000, 64, 2000, "raid0", "xfs", []),
    ]
    got = {(r.host, r.process): r for r in microshard_layout(spark.createDataFrame(rows, schema)).collect()}
    first = got["a", 1]
    assert (first.port, first.memory_bytes, first.cpu_shares, first.cpus) == (27040, (7812 - 1) // 3 * 1048576, 341, "0-3")
    assert [got["a", i].data_dir for i in (1, 2, 3)] == [f"/mnt/mongodb/sdb/{i}" for i in (1, 2, 3)]
    assert got["b", 1].data_dir == "/mnt/mongodb/md0/1" and got["b", 1].cpu_shares == 1024
    assert [got["c", i].data_dir for i in (1, 2, 3)] == ["/mnt/mongodb/sdb", "/mnt/mongodb/sdc", "/mnt/mongodb/"]
    assert got["d", 2000].cpu_shares == 1 and got["d", 2000].port == 29039 and got["a", 3].log_path.endswith("shard-3.log")


def test_operations_follow_the_proportions(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    counts = dict(assign_operations(keys, "k", {"READ": 0.8, "UPDATE": 0.15}).groupBy("op").count().collect())
    assert counts.keys() == {"READ", "UPDATE", None}
    assert abs(counts["READ"] - 16000) < 400 and abs(counts[None] - 1000) < 200


def test_shards(spark):
    keys = spark.range(5000).withColumnRenamed("id", "k")
    md5 = {r.k: r.shard for r in hash_shards(keys, "k", 7).collect()}
    assert md5 == {k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 7 for k in range(5000)}
    assert {r.shard for r in hash_shards(keys, "k", 7, "xxhash64").collect()} == set(range(7))
    one = shard_balance(keys.withColumn("k", F.lit(3)), "k", 4).collect()
    assert sorted(r.rows for r in one) == [0, 0, 0, 5000] and {r.max_to_mean for r in one} == {4.0}
    assert [r.share for r in shard_balance(keys.limit(0), "k", 2).collect()] == [None, None]


def test_skew_table(spark):
    keys = [("a",)] * 5 + [("b",)] * 2 + [("c",)] * 2 + [("d",)] + [(None,)]
    got = {r.key: (r.rows, r.rank, r.share, r.cumulative_share) for r in key_skew(spark.createDataFrame(keys, "k string"), "k").collect()}
    n = 11
    assert got["a"] == (5, 1, 5 / n, 5 / n) and got["b"] == (2, 2, 2 / n, 9 / n) == got["c"]
    assert got["d"] == got[None] == (1, 3, 1 / n, 1.0)


RUN = "phase string, threads int, bulkCount int, recordCount int, operationCount int, readAllFields boolean, readProportion float, updateProportion float, scanProportion float, insertProportion float"
CLUSTER = "clusterName string, shardNodes int, processes int, nodeDisks int, machineType string, image string, network string, dataDiskType string, dataDiskRaid string, dataDiskSizeGb int, rootDiskSizeGb int, fileSystem string"
GOOD_RUN = ("load", 1, 100, 1000, 1000, True, 0.8, 0.2, 0.0, 0.0)
GOOD_CLUSTER = ("c", 2, 2, 2, "m", "i", "n", "pd", "raid0", 1, 1, "xfs")


def fields(spark, schema, row, form, **changes):
    names = [f.split(" ")[0] for f in schema.split(", ")]
    changed = tuple(changes.get(n, v) for n, v in zip(names, row))
    checked = validate_rows(spark.createDataFrame([changed], schema), rules(form)).first()
    assert checked.is_valid == (not checked.errors)
    return [e.field for e in checked.errors]


@pytest.mark.parametrize(
    "changes, want",
    [
        ({}, []),
        ({"phase": ""}, ["phase"]),
        ({"phase": None, "threads": 0}, ["phase", "threads"]),
        ({"bulkCount": 0, "recordCount": None, "operationCount": 0}, ["bulkCount", "recordCount", "operationCount"]),
        ({"readProportion": -0.1}, []),
        ({"readProportion": 1.1}, ["readProportion"]),
        ({"readProportion": 1.0, "updateProportion": 1.0}, []),
        ({"scanProportion": None, "insertProportion": 2.0}, ["scanProportion", "insertProportion"]),
    ],
)
def test_run_form(spark, changes, want):
    assert fields(spark, RUN, GOOD_RUN, "run_test", **changes) == want


@pytest.mark.parametrize(
    "changes, want",
    [
        ({}, []),
        ({"shardNodes": 1}, ["shardNodes"]),
        ({"dataDiskRaid": "disk per process"}, []),
        ({"dataDiskRaid": "disk per process", "processes": 3}, ["dataDiskType"]),
        ({"dataDiskRaid": "disk per process", "processes": None}, ["processes", "dataDiskType"]),
        ({"dataDiskRaid": "disk per process", "processes": 500, "nodeDisks": 500}, []),
        ({"dataDiskRaid": None}, ["dataDiskType"]),
        ({"fileSystem": "ntfs"}, ["fileSystem"]),
        ({"fileSystem": None, "clusterName": "", "network": None}, ["clusterName", "network", "fileSystem"]),
        ({"dataDiskSizeGb": 0, "rootDiskSizeGb": None}, ["dataDiskSizeGb", "rootDiskSizeGb"]),
        ({"machineType": "", "image": ""}, ["machineType", "image"]),
    ],
)
def test_cluster_form(spark, changes, want):
    assert fields(spark, CLUSTER, GOOD_CLUSTER, "create_cluster", **changes) == want


def test_other_forms(spark):
    schema = "testNodes int, machineType string, image string, rootDiskSizeGb int"
    assert fields(spark, schema, (1, "m", "i", 1), "create_test_nodes") == []
    assert fields(spark, schema, (0, None, "", 0), "create_test_nodes") == ["testNodes", "machineType", "image", "rootDiskSizeGb"]
    for form in ("delete_cluster", "delete_test_nodes", "delete_file"):
        assert fields(spark, schema, (None, None, None, None), form) == []
    with pytest.raises(ValueError):
        rules("unknown")


def test_strict_run_form(spark):
    rows = [GOOD_RUN, (*GOOD_RUN[:6], -0.5, 1.0, 0.5, 0.0), (*GOOD_RUN[:6], 0.5, 0.4, 0.0, 0.0)]
    checked = validate_rows(spark.createDataFrame(rows, RUN), rules("run_test", strict=True)).collect()
    assert [[e.field for e in r.errors] for r in checked] == [[], ["readProportion"], ["proportions"]]


def test_report_by_field(spark):
    rows = [GOOD_CLUSTER, (*GOOD_CLUSTER[:8], "", *GOOD_CLUSTER[9:]), ("", 2, 3, 2, *GOOD_CLUSTER[4:8], "disk per process", 1, 1, "xfs")]
    report = error_report(validate_rows(spark.createDataFrame(rows, CLUSTER), rules("create_cluster")))
    got = {r.field: (len(r.messages), r.n) for r in report.collect()}
    assert got == {"dataDiskType": (2, 2), "clusterName": (1, 1)}


def test_digest_drops_leading_zeros(spark):
    text = next(t for t in map(str, range(1000)) if hashlib.md5(t.encode()).hexdigest().startswith("00"))
    row = content_digest(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row.md5 == hashlib.md5(text.encode()).hexdigest().lstrip("0") and row.sha1 == hashlib.sha1(text.encode()).hexdigest()
    binary = content_digest(spark.createDataFrame([(bytearray(b"\x00\xff"),)], "t binary"), "t").first()
    assert binary.md5 == hashlib.md5(b"\x00\xff").hexdigest().lstrip("0")


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "name string, body string")
    new = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("n", None)], "name string, body string")
    got = {r.name: r.change for r in snapshot_diff(old, new, "name", "body").collect()}
    assert got == {"a": "removed", "b": "same", "c": "changed", "d": "added", "n": "same"}


def test_duplicates(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (9, "x"), (4, "z")], "id int, body string")
    assert [(r.kept_key, r.copies) for r in duplicate_content(df, "id", "body").collect()] == [(2, 3)]
    assert sorted(r.id for r in without_duplicates(df, "id", "body").collect()) == [1, 2, 4]
