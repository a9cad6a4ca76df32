"""Integer narrowing that wraps, and counts for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_int32(column: Column) -> Column:
    """Low 32 bits as a signed int, also under ANSI mode; fractions are cut toward zero.

    Ordinary encoding uses a cast, which raises on overflow. This one is for callers
    that need two's-complement wrapping.
    """
    low = F.shiftright(F.shiftleft(column.cast("bigint"), 32), 32)
    return low.cast("int")


def truncate_to_int64(column: Column) -> Column:
    """Floating point to bigint, cut toward zero."""
    return column.cast("bigint")


def format_count(column: Column) -> Column:
    """Count with thousands separators."""
    return F.format_number(column, 0)
