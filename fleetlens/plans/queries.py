"""All bound queries and their SQL."""

from fleetlens.plans import inventory_queries, operation_queries, planning_queries, telemetry_queries  # noqa: F401
from fleetlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
