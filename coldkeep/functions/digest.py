"""Order-insensitive content digests.

A digest is the exact sum of one 64-bit hash per row. A sum, unlike XOR, does not
cancel for pairs of equal rows. The two 32-bit halves are summed as longs, which
keeps the aggregate inside generated code, and are joined to a decimal at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_TYPE = "decimal(38,0)"


def row_hash(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """Hash of the named columns, independent of their order in the schema.

    The null flags are part of the input: the hash itself skips NULLs, so a value
    moving between two columns would otherwise go unnoticed.
    """
    names = {name: f"`{name.replace('`', '``')}`" for name in sorted(columns or schema.fieldNames())}
    values = [
        f"array_sort(map_entries({quoted}))" if isinstance(schema[name].dataType, T.MapType) else quoted
        for name, quoted in names.items()
    ]
    flags = [f"isnull({quoted})" for quoted in names.values()]
    return F.expr(f"xxhash64({', '.join([*values, *flags])})")


def half_sums(hash_column: Column) -> list[Column]:
    return [
        F.sum(F.shiftright(hash_column, 32)).alias("_high"),
        F.sum(hash_column.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
    ]


def join_halves(high: Column, low: Column) -> Column:
    shifted = high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)")
    return (shifted + low.cast("decimal(20,0)")).cast(DIGEST_TYPE)


def _totals(df: DataFrame, by: dict[str, Column], columns: list[str] | None) -> DataFrame:
    """Sums per group and task, as `(*by, rows, digest)`.

    A long holds the half-sums of about 2**31 rows. One task never has that many, a
    whole table or chunk may; so the sums of tasks are only joined as decimals. Each
    task sends one row per group to the shuffle.
    """
    hashed = df.select(
        *[c.alias(n) for n, c in by.items()], F.spark_partition_id().alias("_task"),
        row_hash(df.schema, columns).alias("_hash"),
    )
    sums = hashed.groupBy(*by, "_task").agg(F.count("_hash").alias("rows"), *half_sums(F.col("_hash")))
    return sums.select(*by, "rows", join_halves(F.col("_high"), F.col("_low")).alias("digest"))


def _added() -> list[Column]:
    return [
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum("digest"), F.lit(0)).cast(DIGEST_TYPE).alias("digest"),
    ]


def content_totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row `(rows, digest)` over the whole DataFrame; both 0 when it is empty."""
    return _totals(df, {}, columns).agg(*_added())


def grouped_totals(df: DataFrame, by: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """`(rows, digest)` per group, for groups of any size."""
    return _totals(df, by, columns).groupBy(*by).agg(*_added())


def file_totals(df: DataFrame) -> DataFrame:
    """`(file_name, rows, digest)` per Parquet file, in one small shuffle."""
    hashed = df.select(F.col("_metadata.file_name").alias("file_name"), row_hash(df.schema).alias("_hash"))
    sums = hashed.groupBy("file_name").agg(F.count("_hash").alias("rows"), *half_sums(F.col("_hash")))
    return sums.select("file_name", "rows", join_halves(F.col("_high"), F.col("_low")).alias("digest"))
