"""Runs a bound query and its SQL on the same tables and compares the rows as multisets."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession

from fleetlens.plans.queries import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> list[str]:
    """Differences between the query and its SQL; empty where there are none."""
    result = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in result.collect()]
    if name not in ORACLES:
        return [] if got else ["no rows"]
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    problems = []
    if sorted(result.columns) != sorted(columns):
        return [f"columns {sorted(result.columns)} but {sorted(columns)}"]
    for column, kind in result.dtypes:
        if _KINDS.get(kind) != kinds[column]:
            problems.append(f"type of {column}: {kind} but {kinds[column]}")
    got, want = _rows(result.columns, got), _rows(columns, want)
    if not want:
        problems.append("the SQL gives no rows")
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        problems.append(f"{len(got)} rows but {len(want)}; extra {extra}; missing {missing}")
    return problems
