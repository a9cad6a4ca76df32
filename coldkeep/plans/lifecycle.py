"""Ageing of archived runs: what is due to move or to be deleted, and doing it.

Steps leave a trail in the history: all that are due are *planned* in one event each before the first is taken,
and each is marked as done right after it. A job that stops half-way is repeated: what it finished without
saying so is marked, and what is still due is taken again. Until then such a run is `interrupted` in a
reconciliation, never `missing`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from functools import partial
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.model import ArchiveCheckFailed, ArchiveIncomplete, LifecyclePolicy, Rule
from coldkeep.operators.reports import ageing, open_steps
from coldkeep.plans.listing import list_files
from coldkeep.plans.verify import LENIENT
from coldkeep.session import small_frame, together
from coldkeep.sources.archive_store import RUN_COLUMNS, ArchiveStore, Run
from coldkeep.sources.history import Event, History
from coldkeep.sources.hot_table import union_all

_RUN = ["cutoff_date", "run_id"]


class Due(NamedTuple):
    run: Run
    published_at: datetime
    rows: int


def _foreign(store: ArchiveStore, runs: list[Run]) -> DataFrame:
    """Files, rows and newest change of runs of another writer, and whether any of their files can be read.

    Nothing is written. Rows come from the footers that can be read.
    """
    readable = store.by_schema(runs)
    sound = {r for _, members in readable for r in members}
    marks = small_frame(store.spark, [(r.cutoff_date, r.run_id, r in sound) for r in runs],
                        T.StructType([*RUN_COLUMNS, T.StructField("readable", T.BooleanType())]))
    files = list_files(store, runs).groupBy(*_RUN).agg(
        F.count(F.lit(1)).alias("files"), F.max("modified_at").cast("timestamp_ntz").alias("published_at"))
    counted = [
        store.read_paths(store.table_path(members[0].database, members[0].table), schema, [store.run_path(r) for r in members], **LENIENT)
        .groupBy(*_RUN).agg(F.count(F.lit(1)).alias("rows"))
        for schema, members in readable
    ]
    known = marks.join(files, _RUN, "left")
    known = known.join(union_all(counted), _RUN, "left") if counted else known.withColumn("rows", F.lit(None).cast("bigint"))
    none = F.lit(0).cast("bigint")
    return known.select(*_RUN, F.coalesce("files", none).alias("files"), F.coalesce("rows", none).alias("rows"), "published_at", "readable")


def ageing_report(store: ArchiveStore, rule: Rule, policy: LifecyclePolicy, as_of: datetime) -> DataFrame:
    """One row per archived run: files, rows, publishing time and the action due. Nothing is written.

    A run of another writer, which has no manifest, is dated by its newest file. One of which no file can be
    read has the action `unreadable` and never ages; the others do.
    """
    reports = []
    for table in rule.tables:
        runs = store.runs(rule.database, table.name)
        known = store.recorded(runs)
        foreign = [r for r in runs if r not in known]
        told = store.manifest(known).groupBy(*_RUN).agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("rows").cast("bigint").alias("rows"),
            F.max("published_at").alias("published_at"),
        ).withColumn("readable", F.lit(True))
        reports += [r.withColumn("table_name", F.lit(table.name)) for r in ([told, _foreign(store, foreign)] if foreign else [told])]
    aged = ageing(union_all(reports), policy, as_of)
    return aged.withColumn("action", F.when(F.col("readable"), F.col("action")).otherwise("unreadable")).drop("readable")


def record_foreign_runs(store: ArchiveStore, rule: Rule) -> list[Run]:
    """Give readable runs of another writer their manifests; returns the runs that cannot be read."""
    unreadable = []

    def record(run: Run) -> None:
        try:
            store.record(run)
        except ArchiveIncomplete:
            unreadable.append(run)

    for table in rule.tables:
        runs = store.runs(rule.database, table.name)
        known = store.recorded(runs)
        together(store.spark, [partial(record, r) for r in runs if r not in known])
    return sorted(unreadable, key=lambda r: (r.table, r.cutoff_date, r.run_id))


def _due(store: ArchiveStore, rule: Rule, policy: LifecyclePolicy, as_of: datetime, action: str) -> list[Due]:
    """What is due, by run id. One entry per run on the driver."""
    rows = ageing_report(store, rule, policy, as_of).filter(F.col("action") == action).collect()
    due = [Due(Run(rule.database, r["table_name"], r["cutoff_date"], r["run_id"]), r["published_at"], r["rows"]) for r in rows]
    return sorted(due, key=lambda d: (d.run.run_id, d.run.table, d.run.cutoff_date))


def _event(rule: Rule, kind: str, run: Run, rows: int, as_of: datetime, status: str, error: str = "") -> Event:
    folder = f"{run.database}/{run.table}/{run.folder}"
    return Event(run.run_id, rule.name, kind, run.table, rows, (folder,), status, error, as_of, as_of)


def _take(store: ArchiveStore, rule: Rule, kind: str, due: list[Due], as_of: datetime, history: History | None,
          step: Callable[[Due], None]) -> list[Run]:
    """Take the step for every run that is due, with its trail. A failing run does not keep others from theirs.

    Runs of one id follow one another; the first failure is raised when all have had their turn.
    """
    say = history.record if history is not None else lambda events: None
    say([_event(rule, kind, d.run, d.rows, as_of, "planned") for d in due])

    def taken(of_one_id: list[Due]) -> None:
        for d in of_one_id:
            try:
                step(d)
            except Exception as problem:
                say([_event(rule, kind, d.run, d.rows, as_of, "error", str(problem))])
                raise
            say([_event(rule, kind, d.run, d.rows, as_of, "success")])

    together(store.spark, [partial(taken, list(g)) for _, g in groupby(due, key=lambda d: d.run.run_id)])
    return [d.run for d in due]


def close_steps(store: ArchiveStore, rule: Rule, kind: str, as_of: datetime, history: History, cold: ArchiveStore | None = None) -> list[Run]:
    """Mark planned steps as done that were taken, though the job that took them could not say so; returns their runs.

    A run that was to be deleted is not in the store any more. One that was to move is recorded in the other store as well.
    """
    steps = open_steps(history.df().filter(F.col("rule") == rule.name)).filter(F.col("event_type") == kind)
    closed = []
    for name, found in groupby(sorted(steps.collect(), key=lambda r: r["table_name"]), key=lambda r: r["table_name"]):
        there = set(store.runs(rule.database, name))
        for r in found:
            day, run_id = (part.split("=", 1)[1] for part in r["folder"].split("/")[-2:])
            run = Run(rule.database, name, day, run_id)
            if run not in there and (cold is None or cold.recorded([run])):
                closed.append((run, r["row_count"]))
    history.record([_event(rule, kind, run, rows, as_of, "success") for run, rows in closed])
    return [run for run, _ in closed]


def delete_expired(store: ArchiveStore, rule: Rule, policy: LifecyclePolicy, as_of: datetime,
                   history: History | None = None) -> list[Run]:
    """Delete the runs that are due; returns them. Whole runs only, one folder each.

    An interrupted deletion leaves the manifest, so the run is still due and a repeat finishes it.
    """
    if not policy.expiration_days:
        return []
    if history is not None:
        close_steps(store, rule, "expire", as_of, history)
    due = _due(store, rule, policy, as_of, "expire")
    return _take(store, rule, "expire", due, as_of, history, lambda d: store.delete(d.run))


def _recorded(store: ArchiveStore, run: Run) -> tuple[int, Decimal]:
    found = store.manifest([run]).agg(F.sum("rows"), F.sum("digest")).first()
    return found[0], found[1]


def _copy(store: ArchiveStore, cold: ArchiveStore, run: Run, published_at: datetime) -> None:
    """Bring one run to the other store, checked, whatever an earlier attempt left there."""
    if not store.recorded([run]):
        store.record(run)
    recorded = _recorded(store, run)
    if not cold.recorded([run]):
        cold.resume(run.run_id)
    if cold.recorded([run]):
        if _recorded(cold, run) != recorded:
            raise ArchiveCheckFailed(f"run {run.run_id} of {run.table} is on cold storage with other rows")
        return
    cold.files.delete(cold.run_path(run))  # rows of an attempt that stopped before its manifest
    store.check_complete([run])
    [rows] = store.read([run])
    largest = store.manifest([run]).agg(F.max("rows")).first()[0]
    cold.open_run(run.run_id)
    try:
        copy = cold.stage(run, rows.drop("cutoff_date", "run_id"), (), largest, published_at, "scan")
        if (copy.rows, copy.digest) != recorded:
            raise ArchiveCheckFailed(f"copy of run {run.run_id} of {run.table} differs from what was recorded")
    except Exception:
        cold.drop_pending(run.run_id)
        raise
    cold.publish([run])


def move_to_cold(store: ArchiveStore, cold: ArchiveStore, rule: Rule, policy: LifecyclePolicy,
                 as_of: datetime, history: History | None = None) -> list[Run]:
    """Move the runs that are due to an archive store on colder storage; returns them.

    Spark copies the rows. A run is deleted at its old place only when the copy holds the
    rows and digest that were recorded; what an interrupted move left is finished or dropped by
    the next one. The publishing time stays, as later steps count the age from it. Different run
    ids move side by side. Only this job may write to the cold store meanwhile.
    """
    if not policy.transition_days:
        return []
    if history is not None:
        close_steps(store, rule, "move", as_of, history, cold)

    def move(d: Due) -> None:
        _copy(store, cold, d.run, d.published_at)
        store.delete(d.run)

    return _take(store, rule, "move", _due(store, rule, policy, as_of, "transition"), as_of, history, move)
