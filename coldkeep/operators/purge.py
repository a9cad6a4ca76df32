"""Removing archived rows by key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from coldkeep.functions.digest import row_hash
from coldkeep.session import written


def distinct_keys(spark: SparkSession, keys: DataFrame, key: Iterable[str]) -> DataFrame:
    """The archived keys, each once, as a written table.

    Repeats are dropped before the shuffle, so a key that was archived very often costs
    nothing in a join. Because the keys then come straight from a scan, adaptive
    execution can broadcast them if they are few, and split a hot key of the other side
    if they are not; a `distinct` inside the join's plan would stand in its way.
    """
    return written(spark, keys.select(*key).distinct(), "keys")


def purge_by_key(hot: DataFrame, keys: DataFrame, key: Iterable[str]) -> DataFrame:
    """Rows of the hot table whose key is not among the (distinct) archived keys.

    One anti join for single and composite keys; nothing is batched or collected.
    """
    key = list(key)
    return hot.join(keys.select(*key), key, "left_anti")


def purged_by_key(hot: DataFrame, keys: DataFrame, key: Iterable[str]) -> DataFrame:
    """Rows of the hot table that a purge by these keys removes."""
    key = list(key)
    return hot.join(keys.select(*key), key, "left_semi")


def late_rows(spark: SparkSession, expired_rows: DataFrame, archived: DataFrame, key: Iterable[str]) -> DataFrame:
    """Expired rows that the archive does not hold with this key and content, by `_hash` and key, as a written table.

    They arrived, or were changed, after the archive was taken and must stay. Only keys and one hash
    per row are shuffled, and the result is normally empty or tiny.
    """
    by = [*key, "_hash"]
    mine = expired_rows.select(*key, row_hash(expired_rows.schema).alias("_hash"))
    theirs = archived.select(*key, row_hash(archived.schema).alias("_hash")).distinct()
    return written(spark, mine.join(theirs, by, "left_anti").distinct(), "late-rows")
