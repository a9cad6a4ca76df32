import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from coldkeep import ArchiveCheckFailed, KeyAuditFailed, Rule, RunExists, Selection, TableRule
from coldkeep.plans import archive, restore
from coldkeep.plans.verify import verify_rule
from coldkeep.sources.archive_store import ArchiveStore, Run
from tests.conftest import (
    AS_OF,
    ITEMS_RULE,
    ORDERS_RULE,
    SENSOR_RULE,
    at,
    rows_of,
    rule,
    small_items,
    small_orders,
    small_sensors,
)

CASES = {
    "single": (ORDERS_RULE, small_orders, None, 5, 3),
    "composite": (ITEMS_RULE, small_items, None, 5, 3),
    "chunked": (SENSOR_RULE, small_sensors, "month", 7, 3),
    "chunked by key": (ORDERS_RULE, small_orders, "year", 5, 3),
}


@pytest.mark.parametrize("encoding", ["native", "canonical"])
@pytest.mark.parametrize("case", CASES)
def test_archive_purge_restore(spark, world, case, encoding):
    table, make, unit, old, kept = CASES[case]
    original = make(spark)
    hot = {table.name: world.load(original, table, unit)}
    plan = rule(table, encoding=encoding)
    first = archive.archive_rule(spark, plan, world.store, hot, AS_OF, "12e45678", world.history).first()
    assert (first["rows_archived"], first["chunk_deleted"] + first["key_deleted"]) == (old, old)
    assert (first["rows_remaining"], first["mismatch"]) == (kept, False)
    assert hot[table.name].count() == kept
    runs = world.store.runs("testdb", table.name)
    archived = restore.archived_rows(world.store, runs, original.schema, encoding).select(*original.columns)
    # purged and archived together are the original, and share no key
    assert rows_of(hot[table.name].df().unionByName(archived)) == rows_of(original)
    assert hot[table.name].df().join(archived, list(table.key), "left_semi").count() == 0
    # nothing is left to archive
    again = archive.archive_rule(spark, plan, world.store, hot, AS_OF, "00000002", world.history).first()
    assert (again["rows_archived"], again["files"], again["rows_remaining"]) == (0, 0, kept)
    assert len(world.store.runs("testdb", table.name)) == 1
    # restoring gives the original back, NULLs and microseconds included
    restore.restore_rule(spark, plan, world.store, hot, AS_OF, history=world.history)
    assert rows_of(hot[table.name].df()) == rows_of(original)
    # and the restored rows expire again
    third = archive.archive_rule(spark, plan, world.store, hot, AS_OF, "00000003").first()
    assert (third["rows_archived"], third["rows_remaining"]) == (old, kept)


def test_chunks_are_dropped_by_pointer(spark, world):
    hot = {"sensor_data": world.load(small_sensors(spark), SENSOR_RULE, "month")}
    before = hot["sensor_data"].snapshot().parts
    done = archive.archive_rule(spark, rule(SENSOR_RULE), world.store, hot, AS_OF, "0000000a").first()
    after = hot["sensor_data"].snapshot().parts
    assert (done["chunks_dropped"], done["chunk_deleted"], done["key_deleted"]) == (5, 7, 0)
    assert set(after) < set(before) and len(before) - len(after) == 5


def test_boundary_chunk_is_rewritten(spark, world):
    table = TableRule("sensor_data", "time", 250, ("time", "sensor_id"))  # cutoff 2023-04-26
    hot = {"sensor_data": world.load(small_sensors(spark), table, "year")}
    done = archive.archive_rule(spark, rule(table), world.store, hot, AS_OF, "0000000a").first()
    assert (done["rows_archived"], done["chunks_dropped"], done["key_deleted"], done["rows_remaining"]) == (6, 0, 6, 4)


@pytest.mark.parametrize("unit", [None, "month"])
def test_late_rows_survive(spark, world, unit):
    original = small_sensors(spark)
    hot = {"sensor_data": world.load(original, SENSOR_RULE, unit)}
    plan = rule(SENSOR_RULE)
    archive.archive_rule(spark, plan, world.store, hot, AS_OF, "0000000a", purge=False)
    assert hot["sensor_data"].count() == 10
    late = original.filter("sensor_id = 3").withColumn("sensor_id", F.lit(99))
    hot["sensor_data"].append(late)
    archive.purge_run(world.store, plan, hot, AS_OF, "0000000a")
    assert sorted(r["sensor_id"] for r in hot["sensor_data"].df().collect()) == [7, 8, 9, 99]
    # a second purge of the same run finds nothing more
    archive.purge_run(world.store, plan, hot, AS_OF, "0000000a")
    assert hot["sensor_data"].count() == 4


def test_same_count_different_rows_is_not_dropped(spark, world):
    """One archived row vanished and another arrived: the counts agree, the keys do not."""
    original = small_sensors(spark)
    hot = {"sensor_data": world.load(original, SENSOR_RULE, "month")}
    archive.archive_rule(spark, rule(SENSOR_RULE), world.store, hot, AS_OF, "0000000a", purge=False)
    swapped = original.withColumn("sensor_id", F.when(F.col("sensor_id") == 5, 99).otherwise(F.col("sensor_id")))
    other = {"sensor_data": world.load(swapped, SENSOR_RULE, "month", name="swapped")}
    archive.purge_run(world.store, rule(SENSOR_RULE), other, AS_OF, "0000000a")
    assert sorted(r["sensor_id"] for r in other["sensor_data"].df().collect()) == [7, 8, 9, 99]


def test_null_dates_stay(spark, world):
    undated = small_orders(spark).withColumn("created_at", F.when(F.col("id") != 3, F.col("created_at")))
    for unit in (None, "month"):
        hot = {"orders": world.load(undated, ORDERS_RULE, unit, name=f"orders-{unit}")}
        done = archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, f"run-{unit}").first()
        assert (done["rows_archived"], done["rows_remaining"], done["mismatch"]) == (4, 4, False)
        assert 3 in [r["id"] for r in hot["orders"].df().collect()]


def test_several_tables(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE), "order_items": world.load(small_items(spark), ITEMS_RULE)}
    done = archive.archive_rule(spark, rule(ORDERS_RULE, ITEMS_RULE), world.store, hot, AS_OF, "0000000a", world.history)
    assert [(r["table_name"], r["rows_archived"]) for r in done.collect()] == [("orders", 5), ("order_items", 5)]
    events = world.history.df().orderBy("id").collect()
    assert [(e["table_name"], e["status"]) for e in events] == [("orders", "success"), ("order_items", "success")]
    assert len({e["id"] for e in events}) == 2


def test_unusable_key_aborts_the_run(spark, world):
    twice = small_items(spark).withColumn("item_id", F.lit(1))
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE), "order_items": world.load(twice, ITEMS_RULE)}
    with pytest.raises(KeyAuditFailed, match="1 keys shared by 2 rows"):
        archive.archive_rule(spark, rule(ORDERS_RULE, ITEMS_RULE), world.store, hot, AS_OF, "0000000a", world.history)
    assert hot["orders"].count() == 8 and hot["order_items"].count() == 8
    assert world.store.pending_runs() == [] and world.store.runs("testdb", "orders") == []
    assert [(e["table_name"], e["status"]) for e in world.history.df().collect()] == [("order_items", "error")]


def test_null_key_is_refused(spark, world):
    keyless = small_orders(spark).withColumn("id", F.when(F.col("id") != 2, F.col("id")))
    hot = {"orders": world.load(keyless, ORDERS_RULE)}
    with pytest.raises(KeyAuditFailed, match="1 rows without a key"):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")


def test_failing_staged_check_purges_nothing(spark, world, monkeypatch):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    monkeypatch.setattr("coldkeep.sources.archive_store.in_key_order", lambda df, key: df.filter("id <> 2"))
    with pytest.raises(ArchiveCheckFailed):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a", world.history, order="key")
    assert hot["orders"].count() == 8 and world.store.runs("testdb", "orders") == []


def test_run_id_cannot_be_reused(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    with pytest.raises(RunExists):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    assert hot["orders"].count() == 8 and len(world.store.runs("testdb", "orders")) == 1


def test_interrupted_publish_can_be_finished(spark, world):
    hot = world.load(small_orders(spark), ORDERS_RULE)
    staged = archive.stage_table(world.store, rule(ORDERS_RULE), ORDERS_RULE, hot, AS_OF, "0000000a")
    run = staged.run
    # rows moved, manifest not yet
    world.store.files.rename(world.store._staged(run, "rows"), world.store.run_path(run))
    world.store.publish([run])
    assert world.store.manifest([run]).agg(F.sum("rows")).first()[0] == 5
    assert world.store.pending_runs() == []
    world.store.publish([run])


def test_staging_nothing_is_an_error(spark, world):
    empty = small_orders(spark).filter("id > 100")
    with pytest.raises(ValueError, match="no rows"):
        world.store.stage(Run("testdb", "orders", "2023-12-02", "0000000a"), empty, ("id",), 10, AS_OF)


def test_staged_run_is_invisible(spark, world):
    hot = world.load(small_orders(spark), ORDERS_RULE)
    archive.stage_table(world.store, rule(ORDERS_RULE), ORDERS_RULE, hot, AS_OF, "0000000a")
    assert world.store.runs("testdb", "orders") == [] and world.store.pending_runs() == ["0000000a"]
    with pytest.raises(RunExists):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, {"orders": hot}, AS_OF, "0000000a")
    assert world.store.recover() == ([], ["0000000a"])
    assert world.store.pending_runs() == [] and hot.count() == 8


def test_recover_finishes_a_checked_run(spark, world, monkeypatch):
    """The driver dies in the middle of publishing two tables."""
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE), "order_items": world.load(small_items(spark), ITEMS_RULE)}
    plan = rule(ORDERS_RULE, ITEMS_RULE)
    move, moved = world.store.files.rename, []

    def dying(source, target):
        if len(moved) == 1:
            raise SystemExit
        moved.append(target)
        move(source, target)

    monkeypatch.setattr(world.store.files, "rename", dying)
    with pytest.raises(SystemExit):
        archive.archive_rule(spark, plan, world.store, hot, AS_OF, "0000000a")
    monkeypatch.undo()
    assert hot["orders"].count() == 8 and hot["order_items"].count() == 8
    published, dropped = world.store.recover()
    assert sorted(r.table for r in published) == ["order_items", "orders"] and dropped == []
    assert world.store.pending_runs() == []
    archive.purge_run(world.store, plan, hot, AS_OF, "0000000a")
    assert hot["orders"].count() == 3 and hot["order_items"].count() == 3
    restore.restore_rule(spark, plan, world.store, hot, AS_OF)
    assert rows_of(hot["orders"].df()) == rows_of(small_orders(spark))


def test_store_that_writes_in_place(spark, world, monkeypatch):
    store = ArchiveStore(spark, f"{world.root}/objects", in_place=True)
    plan, original = rule(ORDERS_RULE), small_orders(spark)
    hot = {"orders": world.load(original, ORDERS_RULE)}
    rows_moved = []
    move = store.files.rename
    monkeypatch.setattr(store.files, "rename", lambda a, b: rows_moved.append(a) or move(a, b))
    # an unfinished run is not seen, and dropping it removes its rows
    staged = archive.stage_table(store, plan, ORDERS_RULE, hot["orders"], AS_OF, "0000000a")
    assert store.runs("testdb", "orders") == [] and store.files.exists(store.run_path(staged.run))
    assert store.recover() == ([], ["0000000a"])
    assert not store.files.exists(store.run_path(staged.run))
    # a finished one works like any other, without its rows being moved
    done = archive.archive_rule(spark, plan, store, hot, AS_OF, "0000000b").first()
    assert (done["rows_archived"], done["rows_remaining"]) == (5, 3)
    assert [("/manifest/" in m) for m in rows_moved] == [True]
    verified = verify_rule(spark, plan, store).collect()
    assert {r["status"] for r in verified} == {"OK"} and sum(r["rows"] for r in verified) == 5
    restore.restore_rule(spark, plan, store, hot, AS_OF)
    assert rows_of(hot["orders"].df()) == rows_of(original)
    # a failing check leaves the published run alone
    monkeypatch.setattr("coldkeep.sources.archive_store.in_key_order", lambda df, key: df.filter("id <> 2"))
    with pytest.raises(ArchiveCheckFailed):
        archive.archive_rule(spark, plan, store, hot, AS_OF, "0000000c", order="key")
    assert [r.run_id for r in store.runs("testdb", "orders")] == ["0000000b"] and store.pending_runs() == []
    assert not store.files.exists(store.run_path(Run("testdb", "orders", "2023-12-02", "0000000c")))


def test_reserved_column_names_are_refused(spark, world):
    odd = small_orders(spark).withColumnRenamed("notes", "Run_Id")
    hot = {"orders": world.load(odd, ORDERS_RULE)}
    with pytest.raises(ValueError, match="Run_Id"):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    assert hot["orders"].count() == 8 and world.store.pending_runs() == []


def test_events_can_be_timed(spark, world):
    ticks = iter(AS_OF + timedelta(seconds=n) for n in range(9))
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a", world.history, clock=lambda: next(ticks))
    event = world.history.df().first()
    assert event["end_time"] - event["start_time"] == timedelta(seconds=1)


@pytest.mark.parametrize("order, files", [("key", 3), ("exact", 3), ("scan", None)])
def test_batch_size_bounds_files(spark, world, order, files):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    plan = Rule("r", "testdb", (ORDERS_RULE,), batch_size=2)
    archive.archive_rule(spark, plan, world.store, hot, AS_OF, "0000000a", order=order)
    manifest = world.store.batches(world.store.runs("testdb", "orders")).orderBy("batch").collect()
    assert max(r["rows"] for r in manifest) <= 2 and sum(r["rows"] for r in manifest) == 5
    assert [r["batch"] for r in manifest] == list(range(len(manifest)))
    if files is not None:
        assert [r["rows"] for r in manifest] == [2, 2, 1]


def test_layout_is_sanitised_and_keeps_numeric_run_ids(spark, world):
    table = TableRule("my orders", "created_at", 30, ("id",))
    hot = {"my orders": world.load(small_orders(spark), table, name="o")}
    archive.archive_rule(spark, Rule("r", "shop.db", (table,)), world.store, hot, AS_OF, "00123456")
    assert os.path.isdir(world.local(f"{world.store.root}/shop_db/my_orders/cutoff_date=2023-12-02/run_id=00123456"))
    [df] = world.store.read(world.store.runs("shop.db", "my orders"))
    assert {(r["cutoff_date"], r["run_id"]) for r in df.select("cutoff_date", "run_id").collect()} == {("2023-12-02", "00123456")}


def test_preview_writes_nothing(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    shown = archive.preview_rules([rule(ORDERS_RULE)], hot, AS_OF).first()
    assert (shown["rule"], shown["table_name"], shown["expired_rows"], shown["cutoff"]) == ("r", "orders", 5, at("2023-12-02"))
    assert not os.path.exists(world.local(world.store.root)) and hot["orders"].count() == 8


def test_all_rules_stop_or_go_on(spark, world):
    bad = TableRule("bad", "created_at", 30, ("shipped",))
    rules = [Rule("one", "db", (bad,)), Rule("two", "db", (ORDERS_RULE,))]
    hot = {"bad": world.load(small_orders(spark), bad), "orders": world.load(small_orders(spark), ORDERS_RULE)}
    ids = {"one": "00000001", "two": "00000002"}
    with pytest.raises(KeyAuditFailed):
        archive.archive_all_rules(spark, rules, world.store, hot, AS_OF, ids)
    assert hot["orders"].count() == 8
    done = archive.archive_all_rules(spark, rules, world.store, hot, AS_OF, ids, world.history, keep_going=True)
    told = [(r["rule"], r["table_name"], r["rows_archived"], r["rows_remaining"], r["status"]) for r in done.collect()]
    assert sorted(told) == [("one", "bad", 0, None, "error"), ("two", "orders", 5, 3, "success")]
    assert "keys shared" in done.filter("status = 'error'").first()["error_message"]
    assert sorted((e["rule"], e["status"]) for e in world.history.df().collect()) == [("one", "error"), ("two", "success")]
    # nor does a table that is not there
    lost = [Rule("lost", "db", (TableRule("nowhere", "created_at", 30, ("id",)),)), Rule("again", "db", (ORDERS_RULE,))]
    done = archive.archive_all_rules(spark, lost, world.store, hot, AS_OF, {"lost": "00000003", "again": "00000004"}, world.history, keep_going=True)
    assert sorted((r["rule"], r["rows_remaining"], r["status"]) for r in done.collect()) == [("again", 3, "success"), ("lost", None, "error")]
    # a rule without a run id leaves a row and an event too
    done = archive.archive_all_rules(spark, rules[:1], world.store, hot, AS_OF, {}, world.history, keep_going=True)
    assert [(r["run_id"], r["status"]) for r in done.collect()] == [(None, "error")]
    assert world.history.df().filter("run_id = '' and status = 'error'").count() == 1


def test_rows_of_failed_rules_are_counted(spark, world):
    bad = TableRule("bad", "created_at", 30, ("shipped",))
    gone = TableRule("nowhere", "created_at", 30, ("id",))
    rules = [Rule("one", "db", (bad, gone)), Rule("two", "db", (ORDERS_RULE,))]
    hot = {"bad": world.load(small_orders(spark), bad), "orders": world.load(small_orders(spark), ORDERS_RULE)}
    ids = {"one": "00000001", "two": "00000002"}
    done = archive.archive_all_rules(spark, rules, world.store, hot, AS_OF, ids, keep_going=True, count_failed=True)
    told = [(r["table_name"], r["rows_archived"], r["rows_remaining"], r["status"]) for r in done.collect()]
    assert sorted(told) == [("bad", 0, 8, "error"), ("nowhere", 0, None, "error"), ("orders", 5, 3, "success")]


def test_selection_prunes_runs(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF - timedelta(days=290), "0000000a")
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000b")
    find = world.store.runs
    assert [r.run_id for r in find("testdb", "orders")] == ["0000000a", "0000000b"]
    assert [r.run_id for r in find("testdb", "orders", Selection(cutoff_date="2023-12-02"))] == ["0000000b"]
    assert [r.run_id for r in find("testdb", "orders", Selection(run_id="0000000a"))] == ["0000000a"]
    # equality, not substring: the id of one run is not found in another's path
    assert find("testdb", "orders", Selection(run_id="0000")) == []
    assert find("testdb", "orders", Selection(run_id="2023")) == []
    with pytest.raises(ValueError):
        Selection(run_id="0000000*")
    assert isinstance(find("testdb", "orders")[0], Run)


def test_default_archive_shuffles_no_rows(spark, world, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: plans.append(
        (path, self._df._jdf.queryExecution().executedPlan().toString())) or write(self, path, *a, **b))
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    [rows] = [p for path, p in plans if "/rows/" in path]
    assert "Exchange" not in rows


def test_jobs_leave_no_working_folders(spark, world):
    from coldkeep import session

    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    session.release(spark)
    archive.archive_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF, "0000000a", order="exact")
    restore.restore_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF)
    assert session.release(spark) == 0
    with session.own_folders(spark):
        session.together(spark, [lambda: session.workspace(spark, "a"), lambda: session.workspace(spark, "b")])
        session.release(spark)
        assert len(session._folders.get()) == 2
    assert session._folders.get() is None


def test_values_the_canonical_encoding_loses_are_not_purged(spark, world):
    odd = small_orders(spark).withColumn("nested", F.struct(F.col("created_at").alias("at"), F.array("notes").alias("m")))
    hot = {"orders": world.load(odd, ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF, "0000000a")
    restore.restore_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF)
    assert hot["orders"].df().filter("nested.at = created_at and nested.m[0] <=> notes").count() == 8
    lossy = odd.withColumn("nested", F.struct(F.to_binary(F.lit("ff"), F.lit("hex")).alias("b"), F.make_ym_interval(F.lit(1)).alias("i")))
    hot = {"orders": world.load(lossy, ORDERS_RULE, name="lossy")}
    try:
        archive.archive_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF, "0000000b")
    except Exception:
        assert hot["orders"].count() == 8
    else:
        restore.restore_rule(spark, rule(ORDERS_RULE, encoding="canonical"), world.store, hot, AS_OF, Selection(run_id="0000000b"))
        assert hot["orders"].df().exceptAll(lossy).count() == 0


def test_altered_content_is_not_restored(spark, world):
    from coldkeep import ArchiveIncomplete

    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    [run] = world.store.runs("testdb", "orders")
    [rows] = world.store.read([run])
    changed = rows.drop("cutoff_date", "run_id").withColumn("amount", (F.col("amount") + 1).cast("decimal(10,2)"))
    changed = spark.createDataFrame(changed.collect(), changed.schema)
    changed.coalesce(1).write.mode("overwrite").parquet(world.store.run_path(run))
    with pytest.raises(ArchiveIncomplete):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    assert hot["orders"].count() == 3
