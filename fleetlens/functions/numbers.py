"""Whole-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block(number: Column, size: int | Column) -> Column:
    """Which block of ``size`` consecutive numbers a number from 0 on lies in, as a long."""
    return F.call_function("div", number, size if isinstance(size, Column) else F.lit(size))
