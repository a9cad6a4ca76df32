"""Compaction of archived runs: many small files become few of a chosen size, with the run's content proved unchanged.

A run is rewritten if it has at least twice as many files as its bytes need. Its files are packed by bytes,
across batches and writer tasks, by the scan itself: a task reads as many whole files as fit the target
and writes them as one, without a shuffle. The new files are read back, and only if their rows and digest are those that
the manifest recorded does the run's folder change. Schema, date of publication and history stay as they were.

The new files wait in

    <root>/_compacting/<database>/<table>/cutoff_date=.../run_id=.../{rows,manifest,old,_checked}

and the swap is four moves, each of which `recover_compactions` can tell from the folders that are there. A run
whose files do not hold what was recorded, or cannot be read, is reported and left alone.

One compaction at a time per table is assumed, and none next to a restore of the same run. Runs without a
manifest are left alone, since nothing says what they should hold.
"""

from __future__ import annotations

import math
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.digest import file_totals
from coldkeep.functions.names import sanitize
from coldkeep.model import ArchiveIncomplete, Rule, Selection
from coldkeep.operators.row_groups import forget_row_groups
from coldkeep.plans.listing import list_files
from coldkeep.session import prepare, small_frame, together
from coldkeep.sources.archive_store import ARCHIVE_FILES, MANIFEST_SCHEMA, ArchiveStore, Run

TARGET_BYTES = 256 << 20
#: A run is rewritten if it has this many times the files it needs.
WORTHWHILE = 2

COMPACTED, UNCHANGED, DAMAGED, FAILED = "compacted", "unchanged", "damaged", "failed"

COMPACTION_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("cutoff_date", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("files_before", T.LongType()),
    T.StructField("files_after", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("error", T.StringType()),
])

_CHECKED = "_checked"


def _area(store: ArchiveStore, run: Run) -> str:
    return f"{store.root}/_compacting/{sanitize(run.database)}/{sanitize(run.table)}/{run.folder}"


def _packing_session(spark: SparkSession, target_bytes: int) -> SparkSession:
    """A session of the same application whose scans fill a task with `target_bytes` of whole files."""
    session = prepare(spark.newSession())
    session.conf.set("spark.sql.files.maxPartitionBytes", target_bytes)
    session.conf.set("spark.sql.files.openCostInBytes", 0)
    session.conf.set("spark.sql.files.minPartitionNum", 1)
    return session


def _swap(store: ArchiveStore, run: Run) -> None:
    """Put checked files in place of a run's own. What was done of it before is not done again."""
    files, area = store.files, _area(store, run)
    if files.exists(f"{area}/rows"):
        if not files.exists(f"{area}/old"):
            files.rename(store.run_path(run), f"{area}/old")
        files.rename(f"{area}/rows", store.run_path(run))
    if files.exists(f"{area}/manifest"):
        # digests of bytes that are gone
        forget_row_groups(store, run)
        files.delete(store.run_manifest_path(run))
        files.rename(f"{area}/manifest", store.run_manifest_path(run))
    files.delete(area)


def _compact(store: ArchiveStore, run: Run, schema: T.StructType, recorded: tuple, target_bytes: int) -> int:
    """Rewrite one run; returns how many files it has now."""
    session, area = _packing_session(store.spark, target_bytes), _area(store, run)
    store.files.delete(area)
    reader = session.read.schema(schema).option("pathGlobFilter", ARCHIVE_FILES)
    reader.parquet(store.run_path(run)).write.options(**store.write_options).parquet(f"{area}/rows")
    rows, digest, schema_json, published_at = recorded
    file_totals(session.read.schema(schema).parquet(f"{area}/rows")).select(
        "file_name", "rows", "digest", F.lit(schema_json).alias("schema_json"),
        F.lit(published_at.isoformat(sep=" ")).cast("timestamp_ntz").alias("published_at"),
    ).write.parquet(f"{area}/manifest")
    found = session.read.schema(MANIFEST_SCHEMA).parquet(f"{area}/manifest").agg(F.sum("rows"), F.sum("digest"), F.count(F.lit(1))).first()
    if (found[0], found[1]) != (rows, digest):
        raise ArchiveIncomplete(f"run {run.run_id} of {run.table} holds {found[0]} rows that are not the {rows} recorded ones")
    store.files.write_text(f"{area}/{_CHECKED}", "", overwrite=True)
    _swap(store, run)
    return found[2]


def recover_compactions(store: ArchiveStore) -> tuple[list[Run], list[Run]]:
    """Finish swaps whose files were checked, and drop what was not; returns (finished, dropped).

    To be called after a compaction that died, before anything else uses those runs.
    """
    finished, dropped = [], []
    for path in store.files.glob(f"{store.root}/_compacting/*/*/cutoff_date=*/run_id=*"):
        database, table, day, run_id = path.split("/")[-4:]
        run = Run(database, table, day.split("=", 1)[1], run_id.split("=", 1)[1])
        if store.files.exists(f"{path}/{_CHECKED}"):
            _swap(store, run)
            finished.append(run)
        else:
            store.files.delete(path)
            dropped.append(run)
    return finished, dropped


def _compact_or_say(store, table, run, schema, recorded, files, size, target_bytes) -> tuple:
    key = (table, run.cutoff_date, run.run_id)
    if files < max(2, WORTHWHILE * math.ceil(size / target_bytes)):
        return *key, UNCHANGED, files, files, recorded[0], None
    try:
        return *key, COMPACTED, files, _compact(store, run, schema, recorded, target_bytes), recorded[0], None
    except (ArchiveIncomplete, PySparkException, Py4JJavaError) as problem:
        if store.files.exists(f"{_area(store, run)}/{_CHECKED}"):
            raise  # the swap itself failed: `recover_compactions` will finish it
        store.files.delete(_area(store, run))
        return *key, DAMAGED if isinstance(problem, ArchiveIncomplete) else FAILED, files, files, recorded[0], str(problem)


def compact_rule(spark: SparkSession, rule: Rule, store: ArchiveStore, target_bytes: int = TARGET_BYTES,
                 selection: Selection = Selection()) -> DataFrame:
    """Compact the selected runs of a rule; one row per recorded run, with `action` compacted, unchanged, damaged or failed.

    A run that lost a file is `damaged`: its rows are not those of its manifest. One whose files could not be read or written is
    `failed`. Neither is touched, and the other runs go on.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    prepare(spark)
    recover_compactions(store)
    work = []
    for table in rule.selected_tables(selection.table):
        runs = store.recorded(store.runs(rule.database, table.name, selection))
        schemas = {run: schema for schema, members in store.by_schema(runs) for run in members}
        key = ["cutoff_date", "run_id"]
        # one row per run
        told = store.manifest(runs).groupBy(*key).agg(
            F.sum("rows"), F.sum("digest"), F.min("schema_json"), F.min("published_at")).collect()
        there = list_files(store, runs).groupBy(*key).agg(F.count(F.lit(1)), F.sum("length")).collect()
        recorded, sizes = ({(r[0], r[1]): tuple(r[2:]) for r in rows} for rows in (told, there))
        for run in runs:
            at = (run.cutoff_date, run.run_id)
            if run in schemas and at in sizes:
                work.append(partial(_compact_or_say, store, table.name, run, schemas[run], recorded[at], *sizes[at], target_bytes))
    return small_frame(spark, together(spark, work), COMPACTION_SCHEMA)
