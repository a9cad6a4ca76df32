"""Archive jobs: stage, check, publish, purge, record.

All tables of a rule are staged and checked first; any failure drops the whole run.
Only then is the run published, and only published rows are purged, by the keys that
were read back from the archive. A purge that stops half-way can be run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions import canonical
from coldkeep.functions.digest import content_totals, row_hash
from coldkeep.model import ArchiveCheckFailed, RetentionError, Rule, Selection, TableRule, check_rules
from coldkeep.operators.chunks import droppable_chunks
from coldkeep.operators.expire import expired, preview, unexpired
from coldkeep.operators.keys import audit_key
from coldkeep.operators.purge import late_rows
from coldkeep.plans.restore import archived_rows
from coldkeep.session import own_folders, prepare, small_frame, together
from coldkeep.sources.archive_store import ArchiveStore, Run, cutoff_date
from coldkeep.sources.history import Event, History
from coldkeep.sources.hot_table import HotTable, union_all
from coldkeep.sources.jdbc import JdbcTable

Clock = Callable[[], datetime]

SUMMARY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("rows_archived", T.LongType()),
    T.StructField("files", T.LongType()),
    T.StructField("chunks_dropped", T.LongType()),
    T.StructField("chunk_deleted", T.LongType()),
    T.StructField("key_deleted", T.LongType()),
    T.StructField("rows_remaining", T.LongType()),
    T.StructField("mismatch", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


@dataclass(frozen=True)
class Staged:
    run: Run
    table: TableRule
    cutoff: datetime
    rows: int
    files: int


@dataclass(frozen=True)
class Purged:
    chunks_dropped: int
    chunk_deleted: int
    key_deleted: int
    rows_kept: int


def preview_rules(rules: list[Rule], hot: dict[str, HotTable | JdbcTable], as_of: datetime) -> DataFrame:
    """Dry run of one or more rules: expired rows per table.

    Of tables on files, row groups on one side of the cutoff are counted from their footers; a database counts in the scan.
    """
    return union_all([_preview_table(rule, t, hot[t.name], as_of) for rule in rules for t in rule.tables])


def _preview_table(rule: Rule, table: TableRule, hot: HotTable | JdbcTable, as_of: datetime) -> DataFrame:
    cutoff = table.cutoff(as_of)
    if isinstance(hot, JdbcTable):
        return preview([(table.name, hot.df(), table.date_column, cutoff)]).withColumn("rule", F.lit(rule.name))
    return hot.expired_by_footers(table.date_column, cutoff).select(
        F.lit(table.name).alias("table_name"), "expired_rows",
        F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz").alias("cutoff"), F.lit(rule.name).alias("rule"))


def _encode(rule: Rule, df: DataFrame) -> DataFrame:
    return canonical.encode(df) if rule.encoding == "canonical" else df


def stage_table(store: ArchiveStore, rule: Rule, table: TableRule, hot: HotTable | JdbcTable, as_of: datetime,
                run_id: str, order: str = "scan") -> Staged:
    """Write one table's expired rows to the pending area and prove they are all there."""
    cutoff = table.cutoff(as_of)
    run = Run(rule.database, table.name, cutoff_date(cutoff), run_id)
    if isinstance(hot, HotTable):
        hot.check_columns(hot.snapshot().parts_before(cutoff))
    rows = hot.expired(table.date_column, cutoff)
    encoded = _encode(rule, rows)
    checks = [
        lambda: audit_key(rows, table.key, f"table {table.name}"),
        lambda: content_totals(encoded).first(),
    ]
    if rule.encoding == "canonical":
        # Whatever the encoding cannot give back must not be purged.
        checks += [content_totals(rows).first, content_totals(canonical.decode(encoded, rows.schema)).first]
    _, source, *both = together(store.spark, checks)
    if both and both[0] != both[1]:
        raise ArchiveCheckFailed(f"table {table.name}: the canonical encoding does not give back every value")
    if source["rows"] == 0:
        return Staged(run, table, cutoff, 0, 0)
    staged = store.stage(run, encoded, table.key, rule.batch_size, as_of, order)
    if (staged.rows, staged.digest) != (source["rows"], source["digest"]):
        raise ArchiveCheckFailed(
            f"table {table.name}: {source['rows']} rows expired, {staged.rows} staged, or their content differs"
        )
    return Staged(run, table, cutoff, staged.rows, staged.files)


def archived_content(store: ArchiveStore, run: Run, rule: Rule, schema: T.StructType) -> DataFrame:
    """The rows of a published run in the hot table's columns and types."""
    return archived_rows(store, [run], schema, rule.encoding).select(*schema.fieldNames())


def drop_archived_chunks(store: ArchiveStore, run: Run, rule: Rule, table: TableRule, hot: HotTable,
                         cutoff: datetime) -> dict[str, int]:
    """Drop wholly expired chunks whose rows are all archived; rows per dropped chunk.

    Only a new pointer is written. A table without chunks drops nothing.
    """
    snapshot = hot.snapshot()
    old = snapshot.parts_before(cutoff)
    if snapshot.unit is None or not old:
        return {}
    found = droppable_chunks(
        hot.df(old), archived_content(store, run, rule, snapshot.schema), table.date_column, snapshot.unit, cutoff,
    )
    # One row per chunk, so at most as many as the table has expired chunk folders.
    folders = {p.chunk for p in old}
    dropped = {r["chunk"]: r["rows"] for r in found.collect() if r["chunk"] in folders}
    if dropped:
        hot.replace([p for p in old if p.chunk in dropped])
    return dropped


def purge_archived_rows(store: ArchiveStore, run: Run, rule: Rule, table: TableRule, hot: HotTable,
                        cutoff: datetime) -> tuple[int, int]:
    """Remove archived rows; returns how many went and how many expired rows had to stay.

    Rows at or after the cutoff cannot be in the archive, so they are copied without a
    join, and chunks that start after it are not read; of a table in one piece only the files with
    expired rows are rewritten. If the expired rows and the
    archive agree in count and digest of all columns, all of them go and nothing is shuffled.
    Otherwise keys and row hashes are joined, to find rows that were never archived as they are now.
    """
    snapshot = hot.snapshot()
    key = list(table.key)
    parts = snapshot.parts_before(cutoff)
    if not parts:
        return 0, 0
    whole, same = parts, []
    if snapshot.unit is None:
        parts, same = hot.by_file(parts, table.date_column, cutoff)
        if not parts:
            return 0, 0
    rows = hot.df(parts)
    before = expired(rows, table.date_column, cutoff)
    archived = archived_content(store, run, rule, snapshot.schema)
    starts = [p.chunk for p in parts if p.chunk is not None]
    if starts:
        # A constant on the date column reaches the scan, and dropped chunks are not read again.
        archived = unexpired(archived, table.date_column, datetime.fromisoformat(min(starts)))
    found, known = together(hot.spark, [content_totals(before).first, content_totals(archived).first])
    keep = unexpired(rows, table.date_column, cutoff)
    deleted, stay = found["rows"], 0
    if deleted and found != known:
        late = late_rows(hot.spark, before, archived, key)
        marked = before.withColumn("_hash", row_hash(before.schema))
        left = marked.join(late, [*key, "_hash"], "left_semi").select(*rows.columns)
        stay = left.count()
        deleted -= stay
        if stay:
            keep = keep.unionByName(left)
    if deleted:
        hot.replace(whole, keep, same)
    return deleted, stay


def purge_database_rows(store: ArchiveStore, run: Run, rule: Rule, table: TableRule, hot: JdbcTable,
                        cutoff: datetime) -> tuple[int, int]:
    """Remove archived rows from a database; returns how many went and how many expired rows had to stay.

    The expired rows are read once more, as they are now. Only keys go to the database whose row
    the archive holds with this content; a row changed after the extract, or new, stays. What changes
    between this read and the delete, which matches by key, is not seen.
    """
    key = list(table.key)
    before = hot.expired(table.date_column, cutoff)
    archived = archived_content(store, run, rule, before.schema)
    found, known = together(hot.spark, [content_totals(before).first, content_totals(archived).first])
    if not found["rows"]:
        return 0, 0
    gone, stay = before.select(*key), 0
    if found != known:
        late = late_rows(hot.spark, before, archived, key)
        marked = before.select(*key, row_hash(before.schema).alias("_hash"))
        gone = marked.join(late, [*key, "_hash"], "left_anti").select(*key)
        stay = marked.join(late, [*key, "_hash"], "left_semi").count()
    return hot.delete_keys(gone, table.key, run.run_id), stay


def purge_table(store: ArchiveStore, run: Run, rule: Rule, table: TableRule, hot: HotTable | JdbcTable,
                cutoff: datetime) -> Purged:
    """Remove the rows of one published run: whole chunks first, the rest by key and content."""
    if isinstance(hot, JdbcTable):
        return Purged(0, 0, *purge_database_rows(store, run, rule, table, hot, cutoff))
    dropped = drop_archived_chunks(store, run, rule, table, hot, cutoff)
    deleted, stayed = purge_archived_rows(store, run, rule, table, hot, cutoff)
    return Purged(len(dropped), sum(dropped.values()), deleted, stayed)


PURGE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("chunks_dropped", T.LongType()),
    T.StructField("rows_deleted", T.LongType()),
    T.StructField("rows_kept", T.LongType()),
])


def purge_run(store: ArchiveStore, rule: Rule, hot: dict[str, HotTable | JdbcTable], as_of: datetime, run_id: str,
              history: History | None = None) -> DataFrame:
    """Finish the purge of a published run; one row per table.

    Rows already gone are simply not found. `rows_kept` counts expired rows that stay because the
    archive does not hold them as they are now.
    """
    rows, events = [], []
    with own_folders(store.spark):
        for table in rule.tables:
            for run in store.runs(rule.database, table.name, Selection(run_id=run_id)):
                gone = purge_table(store, run, rule, table, hot[table.name], table.cutoff(as_of))
                deleted = gone.chunk_deleted + gone.key_deleted
                rows.append((run_id, rule.name, table.name, gone.chunks_dropped, deleted, gone.rows_kept))
                folder = (f"{rule.database}/{table.name}/{run.folder}",)
                events.append(Event(run_id, rule.name, "purge", table.name, deleted, folder, "success", "", as_of, as_of))
        if history is not None:
            history.record(events)
    return small_frame(store.spark, rows, PURGE_SCHEMA)


def archive_rule(spark: SparkSession, rule: Rule, store: ArchiveStore, hot: dict[str, HotTable | JdbcTable],
                 as_of: datetime, run_id: str, history: History | None = None,
                 order: str = "scan", purge: bool = True, clock: Clock | None = None) -> DataFrame:
    """Archive and purge every table of a rule; one summary row per table.

    Events are timed by `clock`. Without one they carry `as_of`, which keeps a repeated
    run identical.
    """
    prepare(spark)
    with own_folders(spark):
        return _archive_rule(spark, rule, store, hot, as_of, run_id, history, order, purge, clock)


def _archive_rule(spark, rule, store, hot, as_of, run_id, history, order, purge, clock) -> DataFrame:
    store.open_run(run_id)
    now = clock or (lambda: as_of)
    started = now()
    failed: list[Event] = []

    def event(name, rows, folder, error=""):
        return Event(run_id, rule.name, "archive", name, rows, folder,
                     "error" if error else "success", error, started, now())

    def stage(table: TableRule) -> Staged:
        try:
            return stage_table(store, rule, table, hot[table.name], as_of, run_id, order)
        except Exception as problem:
            failed.append(event(table.name, 0, (), str(problem)))
            raise

    try:
        staged = together(spark, [partial(stage, t) for t in rule.tables])
    except Exception:
        store.drop_pending(run_id)
        if history is not None:
            history.record(failed)
        raise
    store.publish([s.run for s in staged if s.rows])
    store.drop_pending(run_id)
    done: list[Event] = []

    def finish(s: Staged) -> tuple:
        folder = (f"{rule.database}/{s.table.name}/{s.run.folder}",) if s.rows else ()
        table = hot[s.table.name]
        try:
            before = table.count() if purge else 0
            gone = purge_table(store, s.run, rule, s.table, table, s.cutoff) if s.rows and purge else Purged(0, 0, 0, 0)
            remaining = table.count()
        except Exception as problem:
            done.append(event(s.table.name, s.rows, folder, str(problem)))
            raise
        done.append(event(s.table.name, s.rows, folder))
        deleted = gone.chunk_deleted + gone.key_deleted
        return (
            run_id, rule.name, s.table.name, s.rows, s.files, gone.chunks_dropped, gone.chunk_deleted,
            gone.key_deleted, remaining, purge and not (before - remaining == deleted == s.rows), "success", "",
        )

    try:
        rows = together(spark, [partial(finish, s) for s in staged])
    finally:
        if history is not None:
            names = [t.name for t in rule.tables]
            history.record(sorted(done, key=lambda e: names.index(e.table_name)))
    return small_frame(spark, rows, SUMMARY_SCHEMA)


def _rows_left(hot: dict[str, HotTable | JdbcTable], name: str) -> int | None:
    """Rows online, or None of a table that is not there or fails again."""
    try:
        return hot[name].count()
    except Exception:
        return None


def archive_all_rules(spark: SparkSession, rules: list[Rule], store: ArchiveStore, hot: dict[str, HotTable | JdbcTable],
                      as_of: datetime, run_ids: dict[str, str], history: History | None = None,
                      keep_going: bool = False, order: str = "scan", clock: Clock | None = None, count_failed: bool = False) -> DataFrame:
    """Archive rule after rule. Stops at the first failure unless told to keep going.

    A failed rule then has one row per table with status `error` and the message; a table of it that was purged before
    another one failed is in the history. With `count_failed`, its `rows_remaining` are counted, and null only for a table
    that cannot be counted; without, they are null, as its tables are not touched again (one may be what failed).
    """
    check_rules(rules)
    reports = []
    for rule in rules:
        run_id = run_ids.get(rule.name)
        try:
            if run_id is None:
                raise RetentionError(f"no run id was given for rule {rule.name}")
            reports.append(archive_rule(spark, rule, store, hot, as_of, run_id, history, order, clock=clock))
        except Exception as problem:
            if not keep_going:
                raise
            if run_id is None and history is not None:
                history.record([Event("", rule.name, "archive", t.name, 0, (), "error", str(problem), as_of, as_of) for t in rule.tables])
            failed = [(run_id, rule.name, t.name, 0, 0, 0, 0, 0, _rows_left(hot, t.name) if count_failed else None, False,
                       "error", str(problem)) for t in rule.tables]
            reports.append(small_frame(spark, failed, SUMMARY_SCHEMA))
    return union_all(reports) if reports else small_frame(spark, [], SUMMARY_SCHEMA)
