"""Inventory listings: ``{"<kind>": {"<id>": {...}}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The objects of each kind of listing.
LISTING_OBJECTS = {
    "disks": "struct<name: string, description: string, sizeGb: bigint, status: string, type: string>",
    "diskTypes": "struct<name: string, description: string, validDiskSize: string>",
    "instances": (
        "struct<name: string, description: string, type: string, status: string, "
        "disks: map<string, struct<name: string, type: string, mode: string, boot: boolean, autodelete: boolean>>, "
        "`network-interfaces`: map<string, struct<network: string, address: string>>, "
        "tags: array<string>>"
    ),
    "machinetypes": "struct<name: string, description: string, cpus: int, memoryMb: int>",
    "images": "struct<name: string, description: string, status: string>",
    "networks": "struct<name: string, description: string, ip4Range: string, ip4Gateway: string>",
    "zones": "struct<name: string, description: string, region: string, status: string>",
}


def read_inventory(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """One row per object of all listings: ``id`` and its fields.

    Listings are read with a fixed schema, one per line; ``multi_line`` takes one listing per file.
    """
    if kind not in LISTING_OBJECTS:
        raise ValueError(f"no listing kind {kind!r}; known: {', '.join(LISTING_OBJECTS)}")
    schema = f"`{kind}` map<string, {LISTING_OBJECTS[kind]}>"
    listings = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return listings.select(F.explode(F.col(f"`{kind}`")).alias("id", "_o")).select("id", "_o.*")
