"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line longer than this many characters goes on as the next line.
MAX_LINE_CHARS = 1 << 20

# The URL form accepted for a script address (whole text must match).
URL_PATTERN = r"\b(https?|ftp)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]"


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``; the whole text where there is none."""
    return F.substring_index(text, mark, -1)


def cut_line(line: Column, max_chars: int = MAX_LINE_CHARS) -> Column:
    """A line in pieces of ``max_chars``; one of exactly k times that length ends with an empty piece."""
    pieces = F.sequence(F.lit(0), F.call_function("div", F.length(line), F.lit(max_chars)))
    start = lambda i: (i * F.lit(max_chars) + F.lit(1)).cast("int")
    return F.transform(pieces, lambda i: F.substring(line, start(i), F.lit(max_chars)))


def cut_line_bytes(line: Column, max_bytes: int = MAX_LINE_CHARS) -> Column:
    """As ``cut_line`` by bytes of UTF-8. What a cut leaves of a character is malformed: a beginning becomes one
    U+FFFD, and so does each byte of an end."""
    raw = F.encode(line, "UTF-8")
    pieces = F.sequence(F.lit(0), F.call_function("div", F.octet_length(raw), F.lit(max_bytes)))
    start = lambda i: (i * F.lit(max_bytes) + F.lit(1)).cast("int")
    return F.transform(pieces, lambda i: F.make_valid_utf8(F.substring(raw, start(i), F.lit(max_bytes)).cast("string")))


def line_array(text: Column, max_size: int = MAX_LINE_CHARS, unit: str = "characters") -> Column:
    """The lines of a text, long ones cut; what follows the last break is a line too, even if empty."""
    size, cut_one = {"characters": (F.length, cut_line), "bytes": (F.octet_length, cut_line_bytes)}[unit]
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n")
    cut = F.flatten(
        F.transform(lines, lambda line: F.when(size(line) < max_size, F.array(line)).otherwise(cut_one(line, max_size)))
    )
    return F.when(size(text) < max_size, lines).otherwise(cut)


def without_empty_tail(lines: Column) -> Column:
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - F.lit(1))).otherwise(lines)


def is_url(text: Column) -> Column:
    return text.rlike(rf"\A(?:{URL_PATTERN})\z")
