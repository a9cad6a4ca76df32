"""Archive names: sanitising, and taking keys apart again."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters an archive path keeps; every other one becomes '_'.
UNSAFE = "[^A-Za-z0-9_-]"


def sanitize(name: str) -> str:
    """One name, on the driver, for building a path."""
    return re.sub(UNSAFE, "_", name)


def sanitized(column: Column) -> Column:
    """The same rule over a column of names."""
    return F.regexp_replace(column, UNSAFE, "_")


def archive_key(database: Column, table: Column, cutoff: Column, run_id: Column, batch: Column) -> Column:
    """`database/table/YYYY-MM-DD/run_NNN.parquet`, the flat text form of an archive name."""
    ordinal = batch.cast("string")
    padded = F.when(F.length(ordinal) < 3, F.lpad(ordinal, 3, "0")).otherwise(ordinal)
    return F.concat(
        sanitized(database), F.lit("/"), sanitized(table), F.lit("/"),
        F.date_format(cutoff, "yyyy-MM-dd"), F.lit("/"),
        run_id, F.lit("_"), padded, F.lit(".parquet"),
    )


def key_file_name(key: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(key, "/", -1)


def key_run_id(key: Column) -> Column:
    """File name up to its first underscore; empty when it has none."""
    name = key_file_name(key)
    return F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(F.lit(""))


def key_mentions(key: Column, text: Column) -> Column:
    """Whether the text occurs anywhere in the key; an empty text or key never matches."""
    return (F.length(key) > 0) & (F.length(text) > 0) & F.contains(key, text)


# Directory layout of a published file; works on URIs with or without an authority.
_RUN_PATH = r"cutoff_date=([^/]+)/run_id=([^/]+)/([^/]+)$"


def path_cutoff_date(path: Column) -> Column:
    return F.regexp_extract(path, _RUN_PATH, 1)


def path_run_id(path: Column) -> Column:
    return F.regexp_extract(path, _RUN_PATH, 2)
