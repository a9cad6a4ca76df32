"""Checks on the declared key. Files have no primary-key constraint, so we test it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldkeep.model import KeyAuditFailed


def duplicate_keys(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Keys held by more than one row, with their row count.

    Counting is map-side first, so a key held by a third of the table is one
    partial row per task at the shuffle.
    """
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def key_report(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """One row: rows, rows with a NULL key part, duplicate keys, rows holding them."""
    key = list(key)
    no_key = F.lit(False)
    for name in key:
        no_key = no_key | F.col(f"`{name}`").isNull()
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    repeated = (F.col("rows") > 1) & ~no_key

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    return counted.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
        total(no_key, F.col("rows")).alias("null_key_rows"),
        total(repeated, F.lit(1)).alias("duplicate_keys"),
        total(repeated, F.col("rows")).alias("duplicate_rows"),
    )


def audit_key(df: DataFrame, key: Iterable[str], what: str) -> None:
    """Raise unless the key is present and unique."""
    key = list(key)
    missing = [k for k in key if k not in df.columns]
    if missing:
        raise KeyAuditFailed(f"{what}: key column(s) {missing} do not exist")
    found = key_report(df, key).first()
    if found["null_key_rows"] or found["duplicate_keys"]:
        raise KeyAuditFailed(
            f"{what}: key {key} is not usable: {found['null_key_rows']} rows without a key, "
            f"{found['duplicate_keys']} keys shared by {found['duplicate_rows']} rows"
        )
