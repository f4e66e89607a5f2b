"""Fleet inventory: published views, nested parts, tags, counts, options."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.roles import ROLE_NAME, ROLE_TAG
from fleetlens.functions.text import is_url

# Published columns of each inventory kind (name in the listing -> name here).
INVENTORY_COLUMNS = {
    "disks": {
        "name": "name", "description": "description", "sizeGb": "size_gb", "status": "status", "type": "type",
    },
    "diskTypes": {"name": "name", "description": "description", "validDiskSize": "valid_disk_size"},
    "instances": {
        "name": "name", "description": "description", "type": "type", "status": "status", "disks": "disks",
        "network-interfaces": "network_interfaces", "tags": "tags",
    },
    "machinetypes": {"name": "name", "description": "description", "cpus": "cpus", "memoryMb": "memory_mb"},
    "images": {"name": "name", "description": "description", "status": "status"},
    "networks": {
        "name": "name", "description": "description", "ip4Range": "ip4_range", "ip4Gateway": "ip4_gateway",
    },
    "zones": {"name": "name", "description": "description", "region": "region", "status": "status"},
}

# Roles counted on the fleet chart, with their labels, in chart order.
CHART_ROLES = (("shard", "Shard nodes"), ("conf", "Config nodes"), ("puppet", "Puppet nodes"))
RUNNING = "RUNNING"

# Scheme of a database address that states none.
DEFAULT_SCHEME = "mongodb://"

# Roles in the order in which their nodes are taken down.
CLUSTER_TEARDOWN = ("shard", "conf", "puppet")
TEST_TEARDOWN = ("test", "test-jump")


def inventory_view(df: DataFrame, kind: str) -> DataFrame:
    """The published columns of an inventory kind, under plain names, after the object's ``id``."""
    columns = [F.col(f"`{old}`").alias(new) for old, new in INVENTORY_COLUMNS[kind].items()]
    return df.select("id", *columns)


def endpoint_columns(
    df: DataFrame, project: str, cluster: str = "cluster", role: str = "role", user: str = "user", address: str = "address"
) -> DataFrame:
    """Adds ``server_name``, ``internal_host``, ``user_name``, ``address_url`` and ``address_is_url``."""
    server = F.concat(F.col(cluster), F.lit("-"), F.col(role))
    link = F.col(address)
    with_scheme = F.when(link.contains("//"), link).otherwise(F.concat(F.lit(DEFAULT_SCHEME), link))
    return df.withColumns(
        {
            "server_name": server,
            "internal_host": F.concat(server, F.lit(f".c.{project}.internal")),
            "user_name": F.substring_index(F.col(user), "@", 1),
            "address_url": with_scheme,
            "address_is_url": is_url(link),
        }
    )


def explode_instances(df: DataFrame, what: str) -> DataFrame:
    """One row per attached disk, network interface or tag of each instance (``id``, ``name``)."""
    if what == "disks":
        return df.select("id", "name", F.explode("disks").alias("disk_index", "_d")).select(
            "id",
            "name",
            "disk_index",
            F.col("_d.name").alias("disk_name"),
            F.col("_d.type").alias("disk_type"),
            F.col("_d.mode").alias("mode"),
            F.col("_d.boot").alias("boot"),
            F.col("_d.autodelete").alias("autodelete"),
        )
    if what == "interfaces":
        return df.select("id", "name", F.explode("network_interfaces").alias("interface", "_i")).select(
            "id", "name", "interface", F.col("_i.network").alias("network"), F.col("_i.address").alias("address")
        )
    if what == "tags":
        return df.select("id", "name", F.explode("tags").alias("tag"))
    raise ValueError(f"no part {what!r} of an instance; known: disks, interfaces, tags")


def _has_tags(tags_col: str, tags: Sequence[str | Column]) -> Column:
    held = [F.array_contains(F.col(tags_col), t) for t in tags]
    return reduce(lambda a, b: a & b, held) if held else F.lit(True)


def with_all_tags(df: DataFrame, tags_col: str, tags: Sequence[str | Column] | None) -> DataFrame:
    """Rows that carry every requested tag. NULL tags never match; no request keeps every row."""
    return df.filter(_has_tags(tags_col, tags)) if tags else df


def classify_nodes(df: DataFrame, name_col: str, cluster: str | Column) -> DataFrame:
    """Adds ``role``: conf or shard by host name ``<cluster>-<role>-node-<digits>``, else NULL."""
    name = F.col(name_col)
    cluster = F.lit(cluster) if isinstance(cluster, str) else cluster
    role = F.lit(None).cast("string")
    for known in ("conf", "shard"):
        prefix = F.concat(cluster, F.lit(f"-{ROLE_NAME[known]}-node-"))
        number = F.substr(name, F.length(prefix) + 1)
        role = F.when(name.startswith(prefix) & number.rlike(r"\A[0-9]+\z"), F.lit(known)).otherwise(role)
    return df.withColumn("role", role)


def node_addresses(instances: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Every interface address of the matching instances."""
    return explode_instances(with_all_tags(instances, "tags", tags), "interfaces").select("id", "interface", "address")


def node_names(instances: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """The name of every matching instance."""
    return with_all_tags(instances, "tags", tags).select("id", "name")


def first_public_address(instances: DataFrame, interfaces: str = "interfaces") -> DataFrame:
    """Adds ``public_address``: the NAT address of the first access config of the first interface that has any."""
    configs = F.flatten(
        F.transform(F.col(interfaces), lambda i: F.coalesce(i["access_configs"], F.array().cast("array<struct<nat_ip:string>>")))
    )
    return instances.withColumn("public_address", F.try_element_at(configs, F.lit(1))["nat_ip"])


def first_network(instances: DataFrame, interfaces: str = "interfaces") -> DataFrame:
    """Adds ``network``: that of the first interface, NULL where there is none."""
    return instances.withColumn("network", F.try_element_at(F.col(interfaces), F.lit(1))["network"])


def _role_counts(running: Column) -> dict[str, Column]:
    counts = {}
    for role, label in CHART_ROLES:
        tagged = F.array_contains("tags", ROLE_TAG[role])
        counts[label] = F.count_if(tagged)
        counts[f"Running {label[0].lower()}{label[1:]}"] = F.count_if(tagged & running)
    return counts


def role_counts(instances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``position``, ``label``, ``value``: nodes and running nodes of each charted role, zeros kept.

    One pass with six counters, combined on the map side. ``by`` gives the counts per group (per poll).
    """
    counts = _role_counts(F.col("status") == RUNNING)
    one = instances.groupBy(*by).agg(*(c.alias(f"_{i}") for i, c in enumerate(counts.values())))
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(f"_{i}").alias("value"))
        for i, label in enumerate(counts)
    ]
    return one.select(*by, F.inline(F.array(*rows)))


def node_liveness(states: DataFrame, order: Sequence[str], node: str = "node", alive: str = "alive") -> DataFrame:
    """The latest alive flag of each node. ``order`` columns are unique per node."""
    newest = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return states.groupBy(node).agg(F.max_by(alive, newest).alias(alive))


def any_running(states: DataFrame, order: Sequence[str], node: str = "node", alive: str = "alive") -> DataFrame:
    """One row: whether any node's latest flag is alive; false without nodes."""
    latest = node_liveness(states, order, node, alive)
    return latest.agg(F.coalesce(F.bool_or(alive), F.lit(False)).alias("any_running"))


def option_list(
    df: DataFrame,
    name: str,
    listing_pos: str,
    descending: bool = False,
    default: str | None = None,
    default_prefix: str | None = None,
    default_first: bool = False,
) -> DataFrame:
    """Distinct names in natural or reverse order, with ``is_default``.

    The default is the name ``default``, or the name listed first among those with ``default_prefix``, or
    the name listed first of all.
    """
    names = df.groupBy(F.col(name).alias("name")).agg(F.min(listing_pos).alias("listing_pos"))
    if default is not None:
        chosen = F.col("name") == default
    elif default_prefix is not None or default_first:
        able = df if default_prefix is None else df.filter(F.col(name).startswith(default_prefix))
        first = able.filter(F.col(name).isNotNull()).agg(F.min(listing_pos)).scalar()
        chosen = F.coalesce(F.col("listing_pos") == first, F.lit(False))
    else:
        chosen = F.lit(False)
    order = F.col("name").desc() if descending else F.col("name").asc()
    return names.filter(F.col("name").isNotNull()).select("name", chosen.alias("is_default")).orderBy(order)


def union_listings(listings: Sequence[DataFrame | None]) -> DataFrame:
    """All rows of the listings in turn, duplicates kept; a missing listing is skipped."""
    present = [d for d in listings if d is not None]
    if not present:
        raise ValueError("no listing is present")
    return reduce(lambda a, b: a.unionByName(b), present)


def teardown_order(
    instances: DataFrame, cluster: str | Column, roles: Sequence[str] = CLUSTER_TEARDOWN
) -> DataFrame:
    """Instances to delete, with ``rank`` (place of the role) and ``role``; twice where two roles match.

    One pass over the instances rather than one per role.
    """
    cluster = F.lit(cluster) if isinstance(cluster, str) else cluster
    steps = F.array(
        *(
            F.when(
                F.array_contains("tags", ROLE_TAG[role]),
                F.struct(F.lit(rank).alias("rank"), F.lit(role).alias("role")),
            )
            for rank, role in enumerate(roles, 1)
        )
    )
    ours = instances.filter(F.array_contains(F.col("tags"), cluster))
    return ours.select("*", F.inline(F.filter(steps, lambda s: s.isNotNull())))


