"""Instants as whole milliseconds since 1970-01-01 UTC, so that no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 24 * 60 * 60 * 1000

# The timestamp form of operation listings, with both spellings of the offset.
ISO_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSX")


def iso_millis(text: Column) -> Column:
    """Milliseconds of an ISO 8601 text with offset; NULL where it does not parse."""
    return F.unix_millis(F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ISO_PATTERNS)))


def wall_millis(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, read as UTC, rounded down."""
    day = F.unix_date(ts.cast("date")).cast("long") * DAY_MS
    in_minute = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + in_minute


def millis_to_iso(millis: Column) -> Column:
    """ISO 8601 text in UTC with milliseconds."""
    wall = F.timestamp_add("MILLISECOND", millis, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
