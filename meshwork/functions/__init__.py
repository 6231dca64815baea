"""Column functions: strict parsing, file names, distances, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_int(text: Column) -> Column:
    """A whole number in full, else null: no fraction, no white space inside."""
    return F.when(text.rlike(_INTEGER), text.try_cast("int"))


def strict_double(text: Column) -> Column:
    """A decimal number in full, else null: suffixes such as 1.0f, which casts accept, are refused."""
    return F.when(text.rlike(_REAL) | F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$"), text.try_cast("double"))


def fixed(line: Column, first: int, last: int) -> Column:
    """Columns first..last (from 1, inclusive) of a fixed-width line, trimmed."""
    return F.trim(F.substring(line, first, last - first + 1))


def file_stem(name: Column) -> Column:
    """The file's name without its last extension, case kept; metadata names come percent-encoded."""
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"^(.+?)(\.[^.]*)?$", 1)


def distance(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = (F.col(a) - F.col(b) for a, b in ((ax, bx), (ay, by), (az, bz)))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def or_default(text: Column, value: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))


def is_difficult(level: Column) -> Column:
    """Levels with little known about the target, in any case."""
    return F.coalesce(F.upper(level).isin("TDARK", "TBIO"), F.lit(False))


def whole_share(values: Column, share: float) -> Column:
    """Index of the share-th value of an ascending list with ``values`` members: halves away from zero."""
    return F.round((values - 1) * share).cast("int")
