"""Verification of newly published runs as a stream.

The source is the manifest, which grows by one folder per published run. The
checkpoint makes every manifest row arrive once, so each archive file is decoded once
however often the stream is started. Because the manifest says what must be there,
files that are damaged, empty or gone are noticed although a reader would skip them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from coldkeep.operators.verify import FILE_KEY
from coldkeep.plans.verify import RESULT_SCHEMA, verify_runs
from coldkeep.session import prepare
from coldkeep.sources.archive_store import MANIFEST_SCHEMA, RUN_COLUMNS, ArchiveStore, Run


def verify_new_runs(spark: SparkSession, store: ArchiveStore, database: str, table: str,
                    output: str, checkpoint: str, files_at_once: int = 1000) -> None:
    """Verify what was published since the last call and add it to the output table.

    A pass takes so many manifest files at a time, so the first call over a long archive is many batches, not one.
    """
    prepare(spark)

    def judge(batch: DataFrame, batch_id: int) -> None:
        # One row per new run.
        fresh = batch.select("cutoff_date", "run_id").distinct().collect()
        if not fresh:
            return
        runs = [Run(database, table, r["cutoff_date"], r["run_id"]) for r in fresh]
        # A run whose manifest arrives in pieces is judged piece by piece.
        results = verify_runs(store, table, runs).join(batch.select(*FILE_KEY), FILE_KEY, "left_semi")
        # The folder is named by the batch, so a repeated batch replaces itself.
        results.select(*RESULT_SCHEMA.fieldNames()).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    schema = T.StructType([*MANIFEST_SCHEMA.fields, *RUN_COLUMNS])
    manifest = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(store.manifest_path(database, table))
    query = (
        manifest.writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def verified(spark: SparkSession, output: str) -> DataFrame:
    """All results so far, one row per file."""
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("batch_id", T.StringType())])
    return spark.read.schema(schema).parquet(output).select("table_name", *FILE_KEY, "status", "rows", "batch_id")
