"""Restore jobs: select archives, align, check keys, append."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions import canonical
from coldkeep.model import NoArchiveFiles, RestoreConflict, Rule, SchemaMismatch, Selection, TableRule
from coldkeep.operators.expire import expired
from coldkeep.operators.restore import (
    align,
    conflicts_with_hot,
    first_archived,
    key_counts,
    repeated_keys,
    without_existing,
)
from coldkeep.plans.listing import list_files
from coldkeep.session import own_folders, prepare, small_frame, together, written
from coldkeep.sources.archive_store import ArchiveStore, Run
from coldkeep.sources.history import Event, History
from coldkeep.sources.hot_table import HotTable, union_all
from coldkeep.sources.jdbc import JdbcTable

RESTORE_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("rows_restored", T.LongType()),
])


def archived_rows(store: ArchiveStore, runs: list[Run], schema: T.StructType, encoding: str = "native") -> DataFrame:
    """Rows of the selected runs in the hot table's shape, with cutoff date and run id.

    Every distinct archived schema is aligned on its own, so old runs with fewer
    columns or narrower types restore next to new ones. Nothing is de-duplicated.
    """
    frames = []
    stored = store.read(runs)
    if not stored:
        raise NoArchiveFiles(f"no readable files in {[r.folder for r in runs]}")
    for df in stored:
        names = [c for c in df.columns if c not in ("cutoff_date", "run_id")]
        rows = df.select(*names, F.col("cutoff_date").alias("_cutoff_date"), F.col("run_id").alias("_run_id"))
        marks = T.StructType([T.StructField("_cutoff_date", T.StringType()), T.StructField("_run_id", T.StringType())])
        full = T.StructType([*schema.fields, *marks.fields])
        if encoding == "canonical":
            extra = [c for c in names if c not in schema.fieldNames()]
            if extra:
                raise SchemaMismatch(f"archived column(s) {extra} do not exist in the hot table")
            rows = canonical.decode(rows, full)
        frames.append(align(rows, full))
    return union_all(frames)


def preview_restore(store: ArchiveStore, rule: Rule, selection: Selection = Selection()) -> DataFrame:
    """Dry run: files and rows per table. Needs no hot table and writes nothing.

    Only files that are there count, by the listing. Rows come from the manifest, or from the
    footers for runs that have none.
    """
    reports = []
    for table in rule.selected_tables(selection.table):
        runs = store.runs(rule.database, table.name, selection, required=True)
        recorded = store.recorded(runs)
        plain = [r for r in runs if r not in recorded]
        there = list_files(store, runs).select("file_name", "run_id", "cutoff_date")
        known = store.manifest(runs).select("file_name", "rows", "run_id", "cutoff_date")
        counted = [known.join(there, ["file_name", "run_id", "cutoff_date"], "left_semi")]
        counted += [
            df.groupBy(F.col("_metadata.file_name").alias("file_name"), "run_id", "cutoff_date")
            .agg(F.count(F.lit(1)).alias("rows"))
            for df in (store.read(plain) if plain else [])
        ]
        reports.append(
            union_all(counted).agg(
                F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows")
            ).select(F.lit(table.name).alias("table_name"), "files", "rows")
        )
    return union_all(reports)


def _rows_that_could_clash(hot: HotTable | JdbcTable, table: TableRule, runs: list[Run]) -> DataFrame:
    """Hot rows whose key can equal an archived one.

    A key that contains the date column can only repeat at the same date, and archived
    dates lie before their cutoff. So later chunks and row groups are not read. The
    folder name drops the time of day of the cutoff, hence one day more.
    """
    if table.date_column not in table.key:
        return hot.df()
    limit = datetime.fromisoformat(max(r.cutoff_date for r in runs)) + timedelta(days=1)
    if isinstance(hot, HotTable):
        return hot.expired(table.date_column, limit)
    return expired(hot.df(), table.date_column, limit)


def restore_table(spark: SparkSession, store: ArchiveStore, runs: list[Run], hot: HotTable | JdbcTable,
                  table: TableRule, encoding: str = "native", on_conflict: str = "error",
                  allow_incomplete: bool = False) -> int:
    """Append the rows of some runs to the hot table; returns how many.

    `error` refuses any key that is already in the table or archived twice. `skip`
    leaves such rows out and takes the earliest archived copy of each key. Runs that
    have lost recorded rows are refused unless `allow_incomplete` is set.
    """
    if on_conflict not in ("error", "skip"):
        raise ValueError("on_conflict must be 'error' or 'skip'")
    with own_folders(spark):
        return _restore_table(spark, store, runs, hot, table, encoding, on_conflict, allow_incomplete)


def _restore_table(spark, store, runs, hot, table, encoding, on_conflict, allow_incomplete) -> int:
    if not allow_incomplete:
        store.check_complete(runs)
    key = table.key
    schema = hot.schema()
    names = schema.fieldNames()
    rows = archived_rows(store, runs, schema, encoding)
    current = _rows_that_could_clash(hot, table, runs)
    if on_conflict == "error":
        counts = key_counts(spark, rows, key)
        twice, existing = together(spark, [repeated_keys(counts, key).count, conflicts_with_hot(counts, current, key).count])
        if twice or existing:
            raise RestoreConflict(
                f"of the keys {list(key)}, {existing} already exist and {twice} are archived more than once"
            )
    else:
        # One copy per key first, so the join meets each key once. Written because the
        # rows feed both the table and the count.
        single = first_archived(rows, key, ["_cutoff_date", "_run_id"])
        rows = written(spark, without_existing(single, current, key).select(*names), "restore")
    count = rows.count()
    if count:
        hot.append(rows.select(*names), key)
    return count


def restore_rule(spark: SparkSession, rule: Rule, store: ArchiveStore, hot: dict[str, HotTable | JdbcTable],
                 as_of: datetime, selection: Selection = Selection(), history: History | None = None,
                 on_conflict: str = "error", allow_incomplete: bool = False,
                 clock: Callable[[], datetime] | None = None) -> DataFrame:
    """Restore the selected archives of a rule; one summary row per table.

    Archives are kept, so restored rows expire again at the next run.
    """
    prepare(spark)
    now = clock or (lambda: as_of)
    started = now()
    rows, events = [], []

    def event(name, count, folders, error=""):
        return Event("restore", rule.name, "restore", name, count, folders,
                     "error" if error else "success", error, started, now())

    for table in rule.selected_tables(selection.table):
        try:
            runs = store.runs(rule.database, table.name, selection, required=True)
            count = restore_table(
                spark, store, runs, hot[table.name], table, rule.encoding, on_conflict, allow_incomplete
            )
        except Exception as problem:
            if history is not None:
                history.record([*events, event(table.name, 0, (), str(problem))])
            raise
        folders = tuple(f"{rule.database}/{table.name}/{r.folder}" for r in runs)
        events.append(event(table.name, count, folders))
        rows.append((rule.name, table.name, count))
    if history is not None:
        history.record(events)
    return small_frame(spark, rows, RESTORE_SCHEMA)
