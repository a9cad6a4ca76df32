"""Expired rows: the filter, its key projection and the dry-run counts."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldkeep.functions.timestamps import cutoff_literal


def is_expired(df: DataFrame, date_column: str, cutoff: datetime) -> Column:
    """Strictly before the cutoff. A NULL date is never expired."""
    return F.col(f"`{date_column}`") < cutoff_literal(cutoff, df.schema[date_column].dataType)


def expired(df: DataFrame, date_column: str, cutoff: datetime) -> DataFrame:
    """Full rows that outlived their online window; the filter reaches the scan."""
    return df.filter(is_expired(df, date_column, cutoff))


def unexpired(df: DataFrame, date_column: str, cutoff: datetime) -> DataFrame:
    """The complement of `expired`, with the rows that have no date."""
    return df.filter(~is_expired(df, date_column, cutoff) | F.col(f"`{date_column}`").isNull())


def expired_keys(df: DataFrame, date_column: str, cutoff: datetime, key: Iterable[str]) -> DataFrame:
    """Only the key of the expired rows; the scan reads key and date columns alone."""
    return expired(df, date_column, cutoff).select(*key)


def preview(tables: Iterable[tuple[str, DataFrame, str, datetime]]) -> DataFrame:
    """Dry run: expired rows and cutoff per (name, table, date column, cutoff)."""
    counts = [
        expired(df, date_column, cutoff)
        .agg(F.count(F.lit(1)).alias("expired_rows"))
        .select(
            F.lit(name).alias("table_name"),
            "expired_rows",
            F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz").alias("cutoff"),
        )
        for name, df, date_column, cutoff in tables
    ]
    return reduce(DataFrame.unionByName, counts)
