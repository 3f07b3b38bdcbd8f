"""Scalar functions in two profiles: standard, and compat with case-blind matching and lenient casts.

All are Spark expressions. The compat profile is opt-in and never changes what the standard one does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a lenient cast gives where the text cannot be read.
ZERO = {"int": "0", "bigint": "0", "double": "0.0", "boolean": "false", "timestamp_ntz": "TIMESTAMP_NTZ '1970-01-01 00:00:00'", "date": "DATE '1970-01-01'"}


def like(c: Column, pattern: str, compat: bool = False) -> Column:
    return c.ilike(pattern) if compat else c.like(pattern)


def lenient_cast(c: Column, kind: str) -> Column:
    """A cast that never fails: unreadable text becomes the type's zero; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(c.try_cast(kind), F.expr(ZERO[kind])))


def in_list(c: Column, items: list, negated: bool = False, compat: bool = False) -> Column:
    """IN; compat ignores null items."""
    if compat:
        items = [x for x in items if x is not None]
    out = c.isin(items) if items else F.when(c.isNotNull(), F.lit(False))
    return ~out if negated else out


def substring(c: Column, start: int, length: int | None = None, compat: bool = False) -> Column:
    """1-based; compat takes starts below 1 as 1."""
    start = max(start, 1) if compat else start
    return F.substring(c, F.lit(start), F.lit(length if length is not None else 2**31 - 1))


def _all_or_null(pick, cols: tuple[Column, ...]) -> Column:
    none = F.lit(False)
    for c in cols:
        none = none | c.isNull()
    return F.when(~none, pick(*cols))


def greatest(*cols: Column, compat: bool = False) -> Column:
    """Compat gives null if any argument is."""
    return _all_or_null(F.greatest, cols) if compat else F.greatest(*cols)


def least(*cols: Column, compat: bool = False) -> Column:
    return _all_or_null(F.least, cols) if compat else F.least(*cols)


def sqrt(c: Column) -> Column:
    """Null below zero."""
    return F.when(c >= 0, F.sqrt(c))


def add_days(c: Column, days: int) -> Column:
    """Whole days later, keeping the time of day and the type."""
    return c + F.make_dt_interval(days=F.lit(days))


def trim_space(c: Column) -> Column:
    """Without white space at either end, tabs and newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """A grouping key blind to case."""
    return F.collate(c, "UTF8_LCASE")
