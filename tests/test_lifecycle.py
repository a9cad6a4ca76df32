"""Lifecycle steps that stop half-way, their trail, history segments, and listing in tasks."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coldkeep.model import LifecyclePolicy, RetentionError
from coldkeep.operators import reports
from coldkeep.plans import archive, lifecycle
from coldkeep.plans.listing import list_files
from coldkeep.plans.verify import verify_against_history
from coldkeep.sources.archive_store import ArchiveStore
from coldkeep.sources.history import Event, History
from tests.conftest import AS_OF, ORDERS_RULE, rows_of, rule, small_orders

LATER = AS_OF + timedelta(days=400)


def archived_twice(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    plan = rule(ORDERS_RULE)
    for run_id, as_of in (("0000aaaa", AS_OF - timedelta(days=290)), ("0000bbbb", AS_OF)):
        archive.archive_rule(spark, plan, world.store, hot, as_of, run_id, world.history)
    return plan


def status(spark, world, plan):
    return {r["run_id"]: r["status"] for r in verify_against_history(spark, plan, world.store, world.history.df()).collect()}


def test_a_step_is_marked_right_after_it(spark, world, monkeypatch):
    plan, delete = archived_twice(spark, world), ArchiveStore.delete

    def failing(self, run):
        if run.run_id == "0000bbbb":
            raise OSError("no connection")
        delete(self, run)

    monkeypatch.setattr(ArchiveStore, "delete", failing)
    with pytest.raises(OSError):
        lifecycle.delete_expired(world.store, plan, LifecyclePolicy(0, 100), LATER, world.history)
    assert status(spark, world, plan) == {"0000aaaa": "expired", "0000bbbb": "match"}
    told = world.history.df().filter("event_type = 'expire'").orderBy("id").collect()
    assert [(e["run_id"], e["status"]) for e in told][:2] == [("0000aaaa", "planned"), ("0000bbbb", "planned")]
    assert {(e["run_id"], e["status"]) for e in told[2:]} == {("0000aaaa", "success"), ("0000bbbb", "error")}
    assert [r["folder"][-8:] for r in reports.open_steps(world.history.df()).collect()] == ["0000bbbb"]
    monkeypatch.undo()
    assert [r.run_id for r in lifecycle.delete_expired(world.store, plan, LifecyclePolicy(0, 100), LATER, world.history)] == ["0000bbbb"]
    assert status(spark, world, plan) == {"0000aaaa": "expired", "0000bbbb": "expired"}
    assert reports.open_steps(world.history.df()).count() == 0


def test_a_move_that_could_not_say_it_is_done(spark, world, monkeypatch):
    plan, cold = archived_twice(spark, world), ArchiveStore(spark, f"{world.root}/cold")
    record = History.record
    monkeypatch.setattr(History, "record", lambda self, events: record(self, [e for e in events if e.status != "success"]))
    lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(100, 0), LATER, world.history)
    monkeypatch.undo()
    assert status(spark, world, plan) == {"0000aaaa": "interrupted", "0000bbbb": "interrupted"}
    # what is in neither store stays open
    cold.delete(cold.runs("testdb", "orders")[0])
    assert lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(100, 0), LATER, world.history) == []
    assert status(spark, world, plan) == {"0000aaaa": "interrupted", "0000bbbb": "moved"}


def test_unreadable_runs_do_not_stop_the_others(spark, world):
    plan = archived_twice(spark, world)
    base = world.store.table_path("testdb", "orders")
    bad = f"{base}/cutoff_date=2023-06-01/run_id=0000cccc/x.parquet"
    world.store.files.write_text(bad, "no parquet")
    small_orders(spark).limit(0).coalesce(1).write.parquet(f"{base}/cutoff_date=2023-06-02/run_id=0000dddd")
    shown = lifecycle.ageing_report(world.store, plan, LifecyclePolicy(0, 100), LATER)
    assert {(r["run_id"], r["rows"], r["action"]) for r in shown.collect()} == {
        ("0000aaaa", 1, "expire"), ("0000bbbb", 4, "expire"), ("0000cccc", 0, "unreadable"), ("0000dddd", 0, "keep")}
    assert len(world.store.recorded(world.store.runs("testdb", "orders"))) == 2  # a report writes nothing
    assert [r.run_id for r in lifecycle.record_foreign_runs(world.store, plan)] == ["0000cccc"]
    assert len(world.store.recorded(world.store.runs("testdb", "orders"))) == 3
    gone = lifecycle.delete_expired(world.store, plan, LifecyclePolicy(0, 100), LATER, world.history)
    assert [r.run_id for r in gone] == ["0000aaaa", "0000bbbb"] and os.path.exists(world.local(bad))


def test_listing_makes_no_call_per_run(spark, world):
    plan = archived_twice(spark, world)
    runs = world.store.runs("testdb", "orders")
    world.store.files.write_text(f"{world.store.run_path(runs[0])}/zero.parquet", "")
    world.store.files.write_text(f"{world.store.run_path(runs[0])}/note.txt", "not an archive file")
    client = spark.sparkContext._gateway._gateway_client
    send, calls = client.send_command, []

    def counted(work):
        calls.clear()
        # but for those by which Python's garbage collector lets go of Java objects
        client.send_command = lambda *a, **b: (a[0].startswith("m\n") or calls.append(a)) and False or send(*a, **b)
        try:
            work()
        finally:
            del client.send_command
        return len(calls)

    list_files(world.store, runs).collect()
    one = counted(lambda: list_files(world.store, runs[:1]).collect())
    assert counted(lambda: list_files(world.store, runs).collect()) == one
    some = counted(lambda: world.store.runs("testdb", "orders"))
    for n in range(5):
        world.store.files.make_directory(f"{world.store.table_path('testdb', 'orders')}/cutoff_date=2023-01-01/run_id=0000000{n}")
    assert counted(lambda: world.store.runs("testdb", "orders")) == some
    found = list_files(world.store, world.store.runs("testdb", "orders")).collect()
    assert sum(r["length"] == 0 for r in found) == 1 and "note.txt" not in {r["file_name"] for r in found}
    assert all(r["modified_at"] is not None for r in found) and plan


def _event(n, minutes):
    start = datetime(2024, 1, 1) + timedelta(minutes=minutes)
    return Event(f"run-{n:03}", f"rule-{n % 3}", "archive", "t", n, ("f",), "success", "", start, start)


def test_segments_are_merged_and_the_newest_opened(spark, world, monkeypatch):
    history = world.history
    for n in range(12):
        history.record([_event(2 * n, n), _event(2 * n + 1, n)])
    before = rows_of(history.df())
    assert history.merge(8) == 12 and [s.events for s in sorted(history.segments(), key=lambda s: s.low)] == [8, 8, 8]
    assert rows_of(history.df()) == before and history.merge(8) == 0
    history.record([_event(99, -5)])  # late, but old
    opened, read = [], History.read
    monkeypatch.setattr(History, "read", lambda self, segments: opened.append({s.name for s in segments}) or read(self, segments))
    assert [r["run_id"] for r in history.recent(limit=3).collect()] == ["run-023", "run-022", "run-021"]
    assert len(set().union(*opened)) == 1
    opened.clear()
    assert [r["run_id"] for r in history.recent("rule-0", 20).collect()] == sorted(
        (f"run-{n:03}" for n in [*range(0, 24, 3)]), reverse=True) + ["run-099"]
    assert len(set().union(*opened)) == 4


def test_an_interrupted_merge_counts_every_event_once(spark, world, monkeypatch):
    history = world.history
    for n in range(6):
        history.record([_event(n, n)])
    before = rows_of(history.df())
    # stops after the merged segment has appeared, before anything is deleted
    monkeypatch.setattr(History, "_finish_merges", lambda self: 0)
    history.merge(100)
    monkeypatch.undo()
    assert len(history.files.names(history.path)) > 7 and rows_of(history.df()) == before
    # stops before it has appeared
    history.record([_event(7, 7)])
    whole = rows_of(history.df())
    monkeypatch.setattr(History, "_place", lambda self, draft, name: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        history.merge(100)
    monkeypatch.undo()
    assert rows_of(history.df()) == whole
    history.merge(100)
    assert rows_of(history.df()) == whole and len(history.segments()) == 1
    assert [n for n in history.files.names(history.path) if n.endswith(".parquet")] == [history.segments()[0].name]


def test_a_merge_that_would_change_events_is_refused(spark, world, monkeypatch):
    for n in range(3):
        world.history.record([_event(n, n)])
    drafted = History._drafted
    monkeypatch.setattr(History, "_drafted", lambda self, events: drafted(self, events.filter("run_id <> 'run-001'")))
    with pytest.raises(RetentionError):
        world.history.merge(100)
    monkeypatch.undo()
    assert world.history.df().agg(F.count("id")).first()[0] == 3 and len(world.history.segments()) == 3
