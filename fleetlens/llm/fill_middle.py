"""Fill-in-middle examples: documents cut into prefix, middle and suffix at boundaries of units.

The code points of many texts, one after another, become classes, kept as a wavelet matrix: one plane of bits per bit of
the class, each plane sorted stably by the bits before it. It gives the number of characters of a class before any
place (rank) in as many steps as a class has bits. The ranks of the classes that end a unit add up to a number of
boundaries; that number is searched by bisection for the place where the wanted unit ends. So no list of units is made.

Only the places of the two cuts come from Python; the example and the text rebuilt from it are Column expressions.

Defined results: a null text is an empty one, of no units, and stays plain; a null id draws as the empty text does;
texts of any length are cut whole; repeated rows come out each; an empty table gives no rows. All columns of the
documents are kept, and those added replace any of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship_package

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BITS = 3
NEWLINE, BLANK, STOP, SYMBOL, DIGIT, LETTER, BEYOND = range(7)
# The classes whose characters end a unit; what is left at the end of a text is a unit as well.
UNITS = {
    "lines": (NEWLINE,),
    "sentences": (NEWLINE, STOP),
    "characters": (NEWLINE, BLANK, STOP, SYMBOL, DIGIT, LETTER, BEYOND),
}
CODE_POINTS = 1 << 20


def _class_of(code: int) -> int:
    c = chr(code)
    if c == "\n":
        return NEWLINE
    if c.isspace():
        return BLANK
    if c in ".!?":
        return STOP
    return DIGIT if c.isdigit() else LETTER if c.isalpha() else SYMBOL


_ASCII = np.array([_class_of(c) for c in range(128)] + [BEYOND], np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; those beyond ASCII are of one class."""
    return _ASCII[np.minimum(codes, 128)]


class Plane:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        # one word more, so that the place after the last bit has a word as well
        raw = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw[: len(packed)] = packed
        self.words = raw.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.zeros = len(bits) - int(np.bitwise_count(self.words).sum(dtype=np.int64))

    def ones(self, place: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.bits, self.planes = bits, []
        for level in reversed(range(bits)):
            bit = (values >> level & 1).astype(bool)
            self.planes.append(Plane(bit))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How often the value stands before each place."""
        first = np.zeros(1, np.int64)
        for level, plane in zip(reversed(range(self.bits)), self.planes):
            if value >> level & 1:
                place, first = plane.zeros + plane.ones(place), plane.zeros + plane.ones(first)
            else:
                place, first = place - plane.ones(place), first - plane.ones(first)
        return place - first

    def boundaries(self, ends: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        """How many characters of these classes stand before each place."""
        return sum(self.rank(value, place) for value in ends)

    def after(self, ends: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in low..high before which ``count`` boundaries stand, by bisection."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(ends, middle) >= count
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


@dataclass(frozen=True)
class Cuts:
    """Per text: its units, the code points of its prefix and of its middle."""

    units: np.ndarray
    prefix: np.ndarray
    middle: np.ndarray


def cut_places(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str) -> Cuts:
    """Cuts each text after the draws ``first`` and ``second`` modulo its number of units and one."""
    ends = UNITS[unit]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kinds = classes(codes)
    matrix = WaveletMatrix(kinds)
    stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], stop[:-1]])
    base = matrix.boundaries(ends, start)
    whole = matrix.boundaries(ends, stop) - base
    last = kinds[np.maximum(stop - 1, 0)] if len(kinds) else np.zeros(len(texts), np.uint8)
    units = whole + ((stop > start) & ~np.isin(last, ends))
    drawn = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    places = []
    for count in drawn:
        place = matrix.after(ends, base + count, start, stop)
        places.append(np.where(count == units, stop, place))
    return Cuts(units, places[0] - start, places[1] - places[0])


def _slices(texts: list[str]):
    """Runs of texts of about ``CODE_POINTS`` code points; a longer text is one alone."""
    at, held = 0, 0
    for n, text in enumerate(texts):
        if held and held + len(text) > CODE_POINTS:
            yield at, n
            at, held = n, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def _cutter(unit: str):
    kind = pa.struct([("n", pa.int64()), ("prefix", pa.int64()), ("middle", pa.int64())])

    def cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        first, second = first.to_numpy(), second.to_numpy()
        found = [cut_places(texts[a:b], first[a:b], second[a:b], unit) for a, b in _slices(texts)]
        columns = [
            pa.array(np.concatenate([getattr(f, name) for f in found]) if found else [], pa.int64())
            for name in ("units", "prefix", "middle")
        ]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    # the names of types as text, so that Spark reads them
    cut.__annotations__ = {"text": pa.Array, "first": pa.Array, "second": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "struct<n:bigint,prefix:bigint,middle:bigint>")


def draws(id_col: str, salt: str) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the salted id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an example was made of."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(output, m + 3, F.length(output))

    def between(a: Column, b: Column) -> Column:
        return F.substring(output, a + 3, b - a - 3)

    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame, *, unit: str = "lines", rate: int = 100, spm: int = 50, salt: str = "7", id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``.

    ``rate`` in a hundred documents are cut, ``spm`` in a hundred of those suffix first, as hashes of their ids draw it.
    Texts that are empty or hold a mark of their own stay plain.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    first, second, third, fourth = draws(id_col, salt)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (third % 100 >= rate), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    cuts = docs.select(F.struct(*kept).alias("doc"), F.struct(
        text.alias("text"), form.alias("form"), _cutter(unit)(text, first, second).alias("cut")).alias("fim"))
    whole, p, m = F.col("fim.text"), F.col("fim.cut.prefix"), F.col("fim.cut.middle")
    prefix, middle = F.substring(whole, F.lit(1), p), F.substring(whole, p + 1, m)
    suffix = F.substring(whole, p + m + 1, F.length(whole))
    form = F.col("fim.form")
    output = (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    return cuts.select(
        "doc.*", F.col("fim.cut.n").alias("n"), form.alias("form"), F.when(form != "plain", p).alias("prefix_chars"),
        F.when(form != "plain", m).alias("middle_chars"), output.alias("output"),
    )
