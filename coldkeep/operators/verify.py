"""Judging archive files from what the manifest, the listing and two reads say.

Spark skips damaged files silently when told to, and may return part of one. So a file
is sound only if a full decode gives as many rows as its footer claims and, where the
archive recorded them, the same rows and digest as when it was written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.digest import half_sums, join_halves, row_hash
from coldkeep.sources.task_files import open_file

FILE_KEY = ["cutoff_date", "run_id", "file_name"]

FACT_SCHEMA = T.StructType([
    T.StructField("cutoff_date", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("recorded_rows", T.LongType()),
    T.StructField("recorded_digest", T.DecimalType(38, 0)),
    T.StructField("footer_rows", T.LongType()),
    T.StructField("decoded_rows", T.LongType()),
    T.StructField("decoded_digest", T.DecimalType(38, 0)),
])
_FACTS = FACT_SCHEMA.fieldNames()[3:]


def _facts(df: DataFrame) -> DataFrame:
    """Bring a partial report to the common columns, NULL where it says nothing."""
    return df.select(
        *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA]
    )


def footer_facts(rows: DataFrame) -> DataFrame:
    """Rows per file according to the footers; reads no data page."""
    return _facts(
        rows.groupBy("cutoff_date", "run_id", F.col("_metadata.file_name").alias("file_name"))
        .agg(F.count(F.lit(1)).alias("footer_rows"))
    )


def decoded_facts(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows and digest per file from a full decode.

    The digest has to be part of the output: with a bare count the optimizer would
    prune every column and decode nothing.
    """
    hashed = rows.select(
        "cutoff_date", "run_id", F.col("_metadata.file_name").alias("file_name"), row_hash(schema).alias("_hash")
    )
    sums = hashed.groupBy(*FILE_KEY).agg(F.count("_hash").alias("decoded_rows"), *half_sums(F.col("_hash")))
    return _facts(sums.withColumn("decoded_digest", join_halves(F.col("_high"), F.col("_low"))))


def recorded_facts(manifest: DataFrame) -> DataFrame:
    return _facts(
        manifest.select(*FILE_KEY, F.col("rows").alias("recorded_rows"), F.col("digest").alias("recorded_digest"))
    )


def listed_facts(listing: DataFrame) -> DataFrame:
    return _facts(listing)


def merge_facts(reports: Iterable[DataFrame]) -> DataFrame:
    """One row per file. A union and one small aggregate instead of a chain of joins."""
    reports = list(reports)
    merged = reports[0]
    for report in reports[1:]:
        merged = merged.unionByName(report)
    return merged.groupBy(*FILE_KEY).agg(*[F.max(c).alias(c) for c in _FACTS])


def undecided(facts: DataFrame) -> DataFrame:
    """Unrecorded, non-empty files that gave no row: either zero-row files or damaged ones."""
    return facts.filter(
        F.col("recorded_rows").isNull() & F.col("decoded_rows").isNull() & (F.col("length") > 0)
    )


def with_status(facts: DataFrame, zero_row_files: DataFrame | None = None) -> DataFrame:
    """Status and usable rows per file; a file that is not OK counts 0 rows.

    MISSING: recorded but not stored. CORRUPT: stored but not readable as written.
    """
    if zero_row_files is not None:
        facts = facts.join(zero_row_files.select(*FILE_KEY, F.lit(True).alias("_empty")), FILE_KEY, "left")
    else:
        facts = facts.withColumn("_empty", F.lit(None).cast("boolean"))
    complete = F.coalesce(F.col("footer_rows") == F.col("decoded_rows"), F.lit(False))
    as_written = F.col("recorded_rows").isNull() | (
        (F.col("recorded_rows") == F.col("decoded_rows")) & (F.col("recorded_digest") == F.col("decoded_digest"))
    )
    status = (
        F.when(F.col("length").isNull(), "MISSING")
        .when((complete & as_written) | F.coalesce(F.col("_empty"), F.lit(False)), "OK")
        .otherwise("CORRUPT")
    )
    judged = facts.withColumn("status", status)
    rows = F.when(F.col("status") == "OK", F.coalesce("decoded_rows", F.lit(0))).otherwise(0).cast("bigint")
    return judged.select(*FILE_KEY, "status", rows.alias("rows"), "recorded_rows", "length")


def _zero_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        sound = []
        for path in batch.column("path").to_pylist():
            with open_file(path) as file:
                try:
                    sound.append(pq.read_metadata(file).num_rows == 0)
                except (pa.ArrowException, OSError):
                    sound.append(False)
        yield batch.select(FILE_KEY).filter(pa.array(sound))


def zero_row_files(facts: DataFrame, table_path: str) -> DataFrame:
    """Which of the files that nothing else could judge are valid Parquet without rows.

    Only footers are read, in tasks, whatever a file's size.
    """
    path = F.format_string("%s/cutoff_date=%s/run_id=%s/%s", F.lit(table_path), *FILE_KEY).alias("path")
    return undecided(facts).select(*FILE_KEY, path).mapInArrow(_zero_row, ", ".join(f"{c} string" for c in FILE_KEY))


def totals(verified: DataFrame) -> DataFrame:
    """Per table: files by status and the rows of sound files."""
    def files(status):
        return F.count_if(F.col("status") == status).alias(f"{status.lower()}_files")

    return verified.groupBy("table_name").agg(
        files("OK"), files("CORRUPT"), files("MISSING"), F.sum("rows").cast("bigint").alias("rows")
    )
