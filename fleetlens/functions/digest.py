"""Content digests and hash positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_leading_zeros(digest: Column) -> Column:
    return F.regexp_replace(digest, "^0+(?=.)", "")


def md5_number(content: Column) -> Column:
    """MD5 in hexadecimal as a number is written: without leading zeros."""
    return without_leading_zeros(F.md5(content))


def hash32(key: Column) -> Column:
    """First 32 bits of the MD5 of the key's text, as a long; the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def hash_fraction(key: Column) -> Column:
    """A repeatable position in [0, 1) for each key."""
    return hash32(key) / F.lit(float(1 << 32))
