"""Row ordinals in key order, and the batches cut from them.

A global `row_number()` would sort the table in one task. Instead the rows are
range-partitioned and sorted into a written table. Within each of its files
`_metadata.row_index` numbers the rows; adding the row counts of the files before it
gives the ordinal. The written table makes the numbering survive lost executors.
Only one count per written file comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.session import small_frame, workspace

def writer_task(file_name: Column) -> Column:
    """Number of the task that wrote a Spark part file; tasks follow the key ranges."""
    return F.regexp_extract(file_name, r"^part-(\d+)-", 1).cast("bigint")


def roll_over(file_name: Column) -> Column:
    """Number of the file within its writer task."""
    return F.regexp_extract(file_name, r"-c(\d+)\.", 1).cast("bigint")


def running_starts(spark: SparkSession, amounts: DataFrame) -> DataFrame:
    """Running totals before each writer task, from rows `(_part, _amount)`, one per task.

    The driver sees at most as many rows as there are shuffle partitions, whatever the
    size of the table. So the result is safe to broadcast.
    """
    counted = sorted((r["_part"], r["_amount"]) for r in amounts.collect())
    totals = [0, *accumulate(amount for _, amount in counted)]
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_start", T.LongType())])
    return small_frame(spark, [(part, start) for (part, _), start in zip(counted, totals)], schema)


def with_ordinal(spark: SparkSession, df: DataFrame, key: Iterable[str]) -> DataFrame:
    """The rows with a 0-based `ordinal` in key order; the key must be unique."""
    key = list(key)
    folder = workspace(spark, "sorted")
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key)
    # No roll-over: one file per task, so its row index numbers the task's rows.
    ordered.write.option("maxRecordsPerFile", 0).parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    part = writer_task(F.col("_metadata.file_name"))
    # Counted from the file footers.
    starts = running_starts(spark, written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_amount")))
    numbered = written.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    return (
        numbered.join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + F.col("_row")).alias("ordinal"))
    )


def batch_plan(spark: SparkSession, rows: DataFrame, key: Iterable[str], batch_size: int) -> DataFrame:
    """Per batch: ordinal, zero-padded name, row count, first and last key.

    Works on the key columns alone.
    """
    key = list(key)
    position = F.struct(*key)
    numbered = with_ordinal(spark, rows.select(*key), key)
    plan = (
        numbered.withColumn("batch", F.floor(F.col("ordinal") / batch_size).cast("bigint"))
        .groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(position).alias("_first"),
            F.max(position).alias("_last"),
        )
    )
    name = F.col("batch").cast("string")
    return plan.select(
        "batch",
        F.when(F.length(name) < 3, F.lpad(name, 3, "0")).otherwise(name).alias("batch_name"),
        "rows",
        *[F.col(f"_first.{k}").alias(f"first_{k}") for k in key],
        *[F.col(f"_last.{k}").alias(f"last_{k}") for k in key],
    )


def in_key_order(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Globally key-ordered tasks in one range shuffle.

    No partition count is given, so adaptive execution sizes the tasks from the real
    shuffle bytes. Written with at most `batch_size` records per file this gives the
    reference batches, except that the last file of each task may be short.
    """
    return df.repartitionByRange(*key).sortWithinPartitions(*key)


def in_exact_batches(spark: SparkSession, df: DataFrame, key: Iterable[str], batch_size: int,
                     rows_per_task: int = 1_000_000) -> DataFrame:
    """Like `in_key_order`, but every task holds whole batches.

    Written with `batch_size` records per file it leaves exactly ceil(n / batch_size)
    files. It costs one more write and shuffle than `in_key_order`, so callers ask for it.
    """
    per_task = max(1, rows_per_task // batch_size) * batch_size
    numbered = with_ordinal(spark, df, key)
    grouped = numbered.withColumn("_task", F.floor(F.col("ordinal") / per_task))
    return grouped.repartitionByRange("_task").sortWithinPartitions("ordinal").drop("_task", "ordinal")
