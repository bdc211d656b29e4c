"""Column builders used by many operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value, no less than ``low`` and no more than ``high``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normalize_log(value: Column, low: Column, high: Column) -> Column:
    """The place of log(1 + value) between those of two limits, 0 to 1; 1 where the limits are equal."""
    return F.when(high <= low, F.lit(1.0)).otherwise(clamp((F.log1p(value) - F.log1p(low)) / (F.log1p(high) - F.log1p(low))))


def aspect_ratio(width: Column, height: Column) -> Column:
    """The longer side by the shorter one; null without a positive size."""
    return F.when((width > 0) & (height > 0), F.greatest(width, height) / F.least(width, height))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The length of a vector."""
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length; an error for a vector of length zero."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.raise_error(F.lit("zero or non-finite vector")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to 0..1; 0 if a vector has length zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, clamp(dot(a, b) / size)).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """The number of bits in which two integers differ."""
    return F.bit_count(a.bitwiseXOR(b))


def lookup(value: Column, table: Mapping[str, object], default=None) -> Column:
    """The entry of a small fixed table."""
    found = F.lit(default)
    if table:
        flat = [F.lit(x) for pair in table.items() for x in pair]
        found = F.coalesce(F.create_map(*flat)[value], F.lit(default)) if default is not None else F.create_map(*flat)[value]
    return found


def ordered_difference(a: Column, b: Column) -> Column:
    """The elements of ``a`` that aren't in ``b``, in order and as often as they are there."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def term(value: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, joined by underscores."""
    return F.array_join(F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), F.lit(0)), "_")


def hex_digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL, in hexadecimal."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def version_tuple(value: Column) -> Column:
    """All integers of a version text, in order."""
    return F.transform(F.regexp_extract_all(value, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def round_half_up(value: Column) -> Column:
    """Rounds halves up."""
    return F.floor(value + 0.5)


def round_half_even(value: Column) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(value, 0)


def path_key(path: Column) -> Column:
    """What two paths of one file have in common where case doesn't count: lower case, one kind of slash."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"))


def map_rows(value: Column) -> Column:
    """A map's entries in the order of their keys."""
    return F.array_sort(F.map_entries(value))


def json_bytes(value: Column) -> Column:
    """The bytes of a structure's JSON in UTF-8."""
    return F.octet_length(F.to_json(value))


def decode_line(raw: Column) -> Column:
    """Bytes as UTF-8, without a byte order mark; bytes that aren't become replacement marks."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "^\ufeff", "")
