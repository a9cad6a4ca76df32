"""Cutoff literals and RFC3339 text."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cutoff_literal(cutoff: datetime, data_type: T.DataType) -> Column:
    """The cutoff as a constant of the date column's own type.

    A literal of another type would put a cast around the column and stop the
    filter from reaching the Parquet or JDBC scan.
    """
    if isinstance(data_type, T.DateType):
        # A date stands for its midnight: it lies before the cutoff exactly when it
        # lies before the first date whose midnight is not before the cutoff.
        day = cutoff.date()
        if cutoff.time() != time(0):
            day += timedelta(days=1)
        return F.lit(day.isoformat()).cast("date")
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
        return F.lit(cutoff.isoformat(sep=" ")).cast(data_type)
    raise TypeError(f"a date column must be a date or timestamp, not {data_type.simpleString()}")


def rfc3339(column: Column, data_type: T.DataType) -> Column:
    """Timestamp or date as RFC3339 text in UTC, fraction without trailing zeros.

    The plain cast already drops trailing zeros of the fraction, so no pattern
    formatter and no regular expression runs per row.
    """
    if isinstance(data_type, T.DateType):
        return F.concat(column.cast("string"), F.lit("T00:00:00Z"))
    if isinstance(data_type, T.TimestampType):
        column = column.cast("timestamp_ntz")
    return F.concat(F.translate(column.cast("string"), " ", "T"), F.lit("Z"))


def parse_rfc3339(column: Column, data_type: T.DataType) -> Column:
    """RFC3339 text back to a date or timestamp; any UTC offset in the text is honoured."""
    instant = column.cast("timestamp")
    if isinstance(data_type, T.TimestampType):
        return instant
    return instant.cast("timestamp_ntz").cast(data_type)


def duration_micros(start: Column, end: Column) -> Column:
    """Run duration in microseconds."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
