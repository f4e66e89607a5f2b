"""Row rules that yield error lists."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Supported file systems, and the disk mode that gives each process a disk of its own.
FILE_SYSTEMS = ("ext4", "xfs", "btrfs")
DISK_PER_PROCESS = "disk per process"

ERRORS = "array<struct<field:string,message:string>>"


class Rule(NamedTuple):
    """A row breaks the rule where ``broken`` holds."""

    field: str
    message: str
    broken: Column


def _empty(field: str) -> Column:
    return F.col(field).isNull() | (F.col(field) == "")


def _below(field: str, least: int) -> Column:
    return F.col(field).isNull() | (F.col(field) < least)


def _above_one(field: str) -> Column:
    return F.col(field).isNull() | (F.col(field) > 1)


def rules(form: str, strict: bool = False) -> list[Rule]:
    """The rules of a form. ``strict`` also asks proportions of a test run to be at least 0 and to sum to 1."""
    # Forms, their fields and messages, in the order in which errors are reported.
    if form == "run_test":
        found = [
            Rule("phase", "Incorrect phase", _empty("phase")),
            Rule("threads", "Incorrect number of threads", _below("threads", 1)),
            Rule("bulkCount", "Bulk count must be greater than 1", _below("bulkCount", 1)),
            Rule("recordCount", "Record count must be greater than 1", _below("recordCount", 1)),
            Rule("operationCount", "Operation count must be greater than 1", _below("operationCount", 1)),
            Rule("readProportion", "Read proportion must be a fraction of 1 or 0", _above_one("readProportion")),
            Rule("updateProportion", "Update proportion must be a fraction of 1 or 0", _above_one("updateProportion")),
            Rule("scanProportion", "Scan proportion must be a fraction of 1 or 0", _above_one("scanProportion")),
            Rule("insertProportion", "Insert proportion must be a fraction of 1 or 0", _above_one("insertProportion")),
        ]
        if strict:
            shares = [f"{p}Proportion" for p in ("read", "update", "scan", "insert")]
            found += [Rule(s, "Proportion must not be negative", F.col(s) < 0) for s in shares]
            total = sum((F.col(s).cast("double") for s in shares), F.lit(0.0))
            found.append(Rule("proportions", "Proportions must sum to 1", F.abs(total - 1) > 1e-6))
        return found
    if form == "create_cluster":
        each = F.col("dataDiskRaid") == DISK_PER_PROCESS
        return [
            Rule("clusterName", "You must specify a name", _empty("clusterName")),
            Rule("shardNodes", "Incorrect number of shards", _below("shardNodes", 2)),
            Rule("processes", "Incorrect number of processes", _below("processes", 1)),
            Rule("nodeDisks", "Incorrect number of disks per node", _below("nodeDisks", 1)),
            Rule("machineType", "You must choose the machine type", _empty("machineType")),
            Rule("image", "You must choose an OS image", _empty("image")),
            Rule("network", "You must choose a network", _empty("network")),
            Rule("dataDiskType", "You must choose the disk type", _empty("dataDiskRaid")),
            Rule(
                "dataDiskType",
                "The number of processes must match the number of disks for standalone disks mode",
                each & ~F.col("processes").eqNullSafe(F.col("nodeDisks")),
            ),
            Rule(
                "fileSystem",
                "You must choose the data filesystem type",
                F.col("fileSystem").isNull() | ~F.col("fileSystem").isin(*FILE_SYSTEMS),
            ),
            Rule("dataDiskSizeGb", "Incorrect data disk size", _below("dataDiskSizeGb", 1)),
            Rule("rootDiskSizeGb", "Incorrect OS disk size", _below("rootDiskSizeGb", 1)),
        ]
    if form == "create_test_nodes":
        return [
            Rule("testNodes", "Incorrect number of shards", _below("testNodes", 1)),
            Rule("machineType", "You must choose the machine type", _empty("machineType")),
            Rule("image", "You must choose an OS image", _empty("image")),
            Rule("rootDiskSizeGb", "Incorrect OS disk size", _below("rootDiskSizeGb", 1)),
        ]
    if form in ("delete_cluster", "delete_test_nodes", "delete_file"):
        return []
    raise ValueError(f"no form {form!r}")


def validate_rows(df: DataFrame, checks: Sequence[Rule]) -> DataFrame:
    """Adds ``errors`` (field and message, in rule order) and ``is_valid``. Per row; no shuffle."""
    found = [
        F.when(r.broken, F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"))) for r in checks
    ]
    errors = F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array()
    checked = df.withColumn("errors", errors.cast(ERRORS))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def error_report(validated: DataFrame) -> DataFrame:
    """``field``, ``messages``, ``n``: the errors of all rows by field. Messages are those of the rules, so few."""
    return (
        validated.select(F.explode("errors").alias("_e"))
        .groupBy(F.col("_e.field").alias("field"))
        .agg(F.sort_array(F.collect_set("_e.message")).alias("messages"), F.count("*").alias("n"))
    )
