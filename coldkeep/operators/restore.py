"""Aligning archived rows with the hot table and finding key collisions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.model import SchemaMismatch
from coldkeep.session import written

# Type changes that keep every value.
_WIDENINGS = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
    T.DateType: (T.TimestampNTZType,),
}


def widens(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of the source type survives a cast to the target type."""
    if source == target or isinstance(source, T.NullType):
        return True
    if isinstance(source, T.DecimalType) and isinstance(target, T.DecimalType):
        whole = target.precision - target.scale >= source.precision - source.scale
        return whole and target.scale >= source.scale
    return isinstance(target, _WIDENINGS.get(type(source), ()))


def _shape(data_type: T.DataType) -> str:
    """The type without nullability flags."""
    return data_type.simpleString()


def align(archived: DataFrame, schema: T.StructType) -> DataFrame:
    """Archived rows in the hot table's shape, matched by column name.

    Columns the archive lacks become NULL. Columns the table lacks, and types that
    would have to narrow, are errors.
    """
    extra = [c for c in archived.columns if c not in schema.fieldNames()]
    if extra:
        raise SchemaMismatch(f"archived column(s) {extra} do not exist in the hot table")
    out = []
    for field in schema.fields:
        if field.name not in archived.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        have = archived.schema[field.name].dataType
        column = F.col(f"`{field.name}`")
        if _shape(have) == _shape(field.dataType):
            out.append(column)
        elif widens(have, field.dataType):
            out.append(column.cast(field.dataType).alias(field.name))
        else:
            raise SchemaMismatch(
                f"column {field.name}: {_shape(have)} does not widen to {_shape(field.dataType)}"
            )
    return archived.select(*out)


def key_counts(spark: SparkSession, archived: DataFrame, key: Iterable[str]) -> DataFrame:
    """Each key to be restored with the number of its copies, as a written table.

    Counting is map-side first, so a key that was archived very often is no hot spot.
    """
    counted = archived.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return written(spark, counted, "restore-keys")


def repeated_keys(counts: DataFrame, key: Iterable[str]) -> DataFrame:
    """Keys that occur more than once in the selected archives."""
    return counts.filter(F.col("copies") > 1).select(*key)


def conflicts_with_hot(counts: DataFrame, hot: DataFrame, key: Iterable[str]) -> DataFrame:
    """Keys to be restored that the hot table already holds.

    The archived keys are the right side: for a restore of a few runs into a huge table
    Catalyst can broadcast them, and the hot keys are not shuffled.
    """
    key = list(key)
    return hot.select(*key).join(counts.select(*key), key, "left_semi").distinct()


def first_archived(archived: DataFrame, key: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key, the earliest by `order`.

    Hardly any key repeats, so only the keys are counted, with map-side combining; rows whose
    key occurs once pass as they are, and only the others are reduced, again
    combined before the shuffle.
    """
    key = list(key)
    rest = [c for c in archived.columns if c not in key]
    counted = archived.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = written(archived.sparkSession, counted.filter("_n > 1").select(*key), "repeated-keys")
    once = archived.join(repeated, key, "left_anti")
    picked = archived.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    first = picked.select(*[F.col(c) if c in key else F.col(f"_row.`{c}`").alias(c) for c in archived.columns])
    return once.select(*archived.columns).unionByName(first)


def without_existing(archived: DataFrame, hot: DataFrame, key: Iterable[str]) -> DataFrame:
    """Archived rows (one per key) whose key the hot table does not hold."""
    key = list(key)
    return archived.join(hot.select(*key), key, "left_anti")
