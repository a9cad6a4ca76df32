import os
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep import LifecyclePolicy, RetentionError, RunExists, SchemaMismatch, Selection, TableRule
from coldkeep.operators import chunks, purge, reports
from coldkeep.plans import archive, lifecycle, restore
from coldkeep.sources.archive_store import ArchiveStore
from coldkeep.sources.hot_table import HotTable
from coldkeep.sources.jdbc import JdbcSource, columns_sql, delete_sql, primary_key_sql, staging_name
from tests.conftest import AS_OF, ORDERS_RULE, SENSOR_RULE, at, rows_of, rule, small_orders, small_sensors


def test_schema_keeps_order_and_types(spark, world):
    hot = world.load(small_orders(spark), ORDERS_RULE)
    assert [(f.name, f.dataType.simpleString()) for f in hot.schema()] == [
        ("id", "int"), ("customer", "string"), ("amount", "decimal(10,2)"), ("notes", "string"), ("shipped", "boolean"),
        ("created_at", "timestamp_ntz")]
    with pytest.raises(RetentionError):
        HotTable(spark, f"{world.root}/nowhere").schema()


def test_unpublished_write_is_never_seen(spark, world):
    hot = world.load(small_orders(spark), ORDERS_RULE)
    hot.write_parts(small_orders(spark).filter("id > 5"), hot.snapshot().version + 1)  # then a crash
    assert hot.count() == 8
    hot.append(small_orders(spark).filter("id = 1").withColumn("id", F.lit(9)))
    assert sorted(r["id"] for r in hot.df().collect()) == list(range(1, 10))


def test_readers_keep_their_snapshot(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    reader = hot["orders"].df()
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    assert reader.count() == 8 and hot["orders"].count() == 3


@pytest.mark.parametrize("unit", [None, "month"])
def test_vacuum_removes_purged_rows_from_disk(spark, world, unit):
    hot = {"sensor_data": world.load(small_sensors(spark), SENSOR_RULE, unit)}
    table = hot["sensor_data"]
    archive.archive_rule(spark, rule(SENSOR_RULE), world.store, hot, AS_OF, "0000000a")
    before = rows_of(table.df())
    assert table.vacuum(keep=2) == [] and table.vacuum() != [] and table.vacuum() == []
    assert rows_of(table.df()) == before
    stored = spark.read.option("recursiveFileLookup", "true").schema(table.schema()).parquet(table.root)
    assert stored.count() == 3


def test_adopted_files_are_left_alone(spark, world, tmp_path):
    source = f"{tmp_path}/orders"
    small_orders(spark).write.parquet(source)
    hot = {"orders": HotTable.adopt(spark, f"{world.root}/hot", [source])}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    hot["orders"].vacuum()
    assert hot["orders"].count() == 3 and spark.read.parquet(source).count() == 8


def test_adopted_chunks(spark, world, tmp_path):
    source = f"file:{tmp_path}/sensors"
    rows = small_sensors(spark)
    rows.withColumn("chunk_start", chunks.chunk_name("time", "month")).write.partitionBy("chunk_start").parquet(source)
    hot = {"sensor_data": HotTable.adopt_chunks(spark, f"{world.root}/hot", source, "time", "month")}
    assert rows_of(hot["sensor_data"].df()) == rows_of(rows)
    done = archive.archive_rule(spark, rule(SENSOR_RULE), world.store, hot, AS_OF, "0000000a").first()
    assert (done["chunks_dropped"], done["rows_remaining"]) == (5, 3)
    with pytest.raises(RetentionError):
        HotTable.adopt_chunks(spark, f"{world.root}/hot2", f"{source}/nothing", "time", "month")


def test_load_checks_chunk_unit(spark, world):
    with pytest.raises(ValueError):
        HotTable.load(spark, f"{world.root}/x", small_sensors(spark), "time", "fortnight")


@pytest.mark.parametrize("unit, expired", [("day", 7), ("week", 6), ("month", 5), ("year", 0)])
def test_chunk_inventory(spark, unit, expired):
    found = chunks.chunk_inventory(small_sensors(spark), "time", unit, at("2023-12-02")).collect()
    assert sum(r["rows"] for r in found) == 10 and sum(r["expired"] for r in found) == expired
    assert [r["chunk_start"] for r in found] == sorted(r["chunk_start"] for r in found)


@pytest.mark.parametrize("unit, cutoff, want", [
    ("day", "2024-01-17 10:00", "2024-01-17"), ("week", "2024-01-17", "2024-01-15"), ("week", "2024-01-15", "2024-01-15"),
    ("month", "2024-02-29 23:59", "2024-02-01"), ("year", "2024-02-29", "2024-01-01"),
])
def test_boundary(unit, cutoff, want):
    assert chunks.boundary(at(cutoff), unit) == at(want)


def test_chunk_end_at_cutoff_is_expired(spark):
    found = chunks.chunk_inventory(small_sensors(spark), "time", "month", at("2023-05-01")).collect()
    assert [r["expired"] for r in found] == [True] * 4 + [False] * 2


def test_purge_with_a_hot_key(spark):
    """A third of all rows, and of all keys, share one value."""
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    keys = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k").filter("k < 100")
    once = purge.distinct_keys(spark, keys, ["k"])
    assert once.count() == keys.distinct().count()
    want = hot.filter("k >= 100").count()
    assert purge.purge_by_key(hot, once, ["k"]).count() == want
    assert purge.purged_by_key(hot, once, ["k"]).count() == 3000 - want


def test_adaptive_execution_splits_a_hot_key(spark):
    hot = spark.range(60_000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v", "repeat('x', 100) as pad")
    keys = purge.distinct_keys(spark, spark.range(0, 60_000, 7).selectExpr("id as k"), ["k"])
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = purge.purge_by_key(hot, keys, ["k"])
        left.collect()
        executed = left._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert "skew=true" in executed


@pytest.mark.parametrize("policy, want", [
    (LifecyclePolicy(30, 365), ["keep", "transition", "transition", "expire"]),
    (LifecyclePolicy(0, 365), ["keep", "keep", "keep", "expire"]),
    (LifecyclePolicy(30, 0), ["keep", "transition", "transition", "transition"]),
    (LifecyclePolicy(), ["keep"] * 4),
])
def test_lifecycle_actions(spark, policy, want):
    rows = [(n, AS_OF - timedelta(days=days) + timedelta(seconds=s)) for n, (days, s) in enumerate([(30, 1), (30, 0), (365, 1), (365, 0)])]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("published_at", T.TimestampNTZType())]))
    assert [r["action"] for r in reports.ageing(df, policy, AS_OF).orderBy("n").collect()] == want


def test_expired_archives_are_deleted(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF - timedelta(days=290), "0000000a")
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000b")
    now = AS_OF + timedelta(days=100)
    shown = lifecycle.ageing_report(world.store, rule(ORDERS_RULE), LifecyclePolicy(30, 365), now).orderBy("run_id").collect()
    assert [(r["run_id"], r["rows"], r["action"]) for r in shown] == [("0000000a", 1, "expire"), ("0000000b", 4, "transition")]
    assert lifecycle.delete_expired(world.store, rule(ORDERS_RULE), LifecyclePolicy(30, 0), now) == []
    gone = lifecycle.delete_expired(world.store, rule(ORDERS_RULE), LifecyclePolicy(30, 365), now)
    assert [r.run_id for r in gone] == ["0000000a"]
    assert [r.run_id for r in world.store.runs("testdb", "orders")] == ["0000000b"]
    assert world.store.runs("testdb", "orders", Selection(run_id="0000000a")) == []
    left = world.local(world.store.table_path("testdb", "orders"))
    assert os.listdir(f"{left}/cutoff_date=2023-12-02") == ["run_id=0000000b"]


def test_move_to_cold_storage(spark, world, monkeypatch):
    hot, plan = {"orders": world.load(small_orders(spark), ORDERS_RULE)}, rule(ORDERS_RULE, batch_size=2)
    archive.archive_rule(spark, plan, world.store, hot, AS_OF, "0000000a", order="exact")
    cold, now = ArchiveStore(spark, f"{world.root}/cold"), AS_OF + timedelta(days=40)
    assert lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(0, 365), now) == []
    assert lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(50, 365), now) == []
    # stopped after the copy was published: repeating it only removes the old place
    with monkeypatch.context() as patch:
        patch.setattr(world.store, "delete", lambda run: (_ for _ in ()).throw(SystemExit))
        with pytest.raises(SystemExit):
            lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(30, 365), now)
    assert len(world.store.runs("testdb", "orders")) == len(cold.runs("testdb", "orders")) == 1
    [run] = lifecycle.move_to_cold(world.store, cold, plan, LifecyclePolicy(30, 365), now)
    assert world.store.runs("testdb", "orders") == [] and cold.runs("testdb", "orders") == [run]
    kept = cold.manifest([run]).collect()
    assert sum(r["rows"] for r in kept) == 5 and max(r["rows"] for r in kept) <= 2
    assert {r["published_at"] for r in kept} == {AS_OF}
    restore.restore_rule(spark, plan, cold, hot, AS_OF)
    assert rows_of(hot["orders"].df()) == rows_of(small_orders(spark))
    # and it still expires by its first publishing time
    assert lifecycle.delete_expired(cold, plan, LifecyclePolicy(30, 365), AS_OF + timedelta(days=365)) == [run]


def test_jdbc_options_and_statements():
    pg = JdbcSource("jdbc:postgresql://h/db", "public", user="u", password="p", connections=4)
    options = pg.options()
    assert options["numPartitions"] == "4" and options["pushDownPredicate"] == "true" and options["user"] == "u"
    assert options["driver"] == "org.postgresql.Driver" and "password" not in repr(pg)
    assert JdbcSource("jdbc:mysql://h/db", "s", driver="own.Driver").options()["driver"] == "own.Driver"
    names = {staging_name(t, r) for t in ("orders", "users", "x" * 80, "x" * 81, "a/b", "a_b") for r in ("0-a", "0-b")}
    assert len(names) == 12 and max(map(len, names)) <= 63 and all(re.fullmatch("[A-Za-z0-9_-]+", n) for n in names)
    assert pg.qualified('we"ird') == '"public"."we""ird"'
    my = JdbcSource("jdbc:mysql://h/db", "shop")
    assert my.qualified("or`der") == "`shop`.`or``der`" and "user" not in my.options()
    assert delete_sql(pg, "t", "s", ("a", "b")) == (
        'DELETE FROM "public"."t" WHERE EXISTS (SELECT 1 FROM "public"."s" WHERE '
        '"public"."s"."a" = "public"."t"."a" AND "public"."s"."b" = "public"."t"."b")')
    assert "table_schema = 'public'" in columns_sql(pg, "it's") and "'it''s'" in columns_sql(pg, "it's")
    assert "PRIMARY KEY" in primary_key_sql(my, "t")
    with pytest.raises(ValueError):
        JdbcSource("jdbc:other:x", "s")
    with pytest.raises(ValueError):
        JdbcSource("jdbc:mysql://h/db", "s", connections=0)


def _weeks(spark, folder, begin, **extra):
    """Ten days of rows in weekly folders; days before `begin` lack the extra columns."""
    days = spark.range(20).select("id", F.date_add(F.lit("2023-01-05").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("at"))
    named = days.withColumn("chunk_start", chunks.chunk_name("at", "week+3"))
    for rows, columns in ((named.filter(F.col("at") < begin), {}), (named.filter(F.col("at") >= begin), extra)):
        rows.withColumns({k: F.lit(v) for k, v in columns.items()}).write.mode("append").partitionBy("chunk_start").parquet(folder)


def test_adopted_parts_share_all_columns(spark, world):
    folder = f"{world.root}/raw"
    _weeks(spark, folder, at("2023-01-12"), note="n")
    hot = HotTable.adopt_chunks(spark, f"{world.root}/hot/t", folder, "at", "week")
    assert hot.schema().fieldNames() == ["id", "at", "note"] and hot.snapshot().unit == "week+3"
    assert hot.df().filter("note = 'n'").count() == 13 and hot.count() == 20
    plan = rule(TableRule("t", "at", 30, ("id",)))
    [done] = archive.archive_rule(spark, plan, world.store, {"t": hot}, at("2023-02-18"), "0000000a").collect()
    assert (done["rows_archived"], done["chunks_dropped"], done["chunk_deleted"], done["mismatch"]) == (14, 2, 14, False)
    [kept] = world.store.read(world.store.runs("testdb", "t"))
    assert kept.filter("note = 'n'").count() == 7
    # a column that turns up in an adopted part afterwards is not dropped silently
    late = spark.createDataFrame([(99, at("2023-01-20"), "n", 1)], "id long, at timestamp_ntz, note string, more int")
    late.write.mode("append").parquet(f"{folder}/chunk_start=2023-01-19")
    with pytest.raises(SchemaMismatch, match="more"):
        archive.archive_rule(spark, plan, world.store, {"t": hot}, at("2023-03-18"), "0000000b")
    assert hot.count() == 7


def test_adopted_parts_must_agree(spark, world):
    folder = f"{world.root}/raw"
    _weeks(spark, folder, at("2023-01-12"))
    spark.createDataFrame([("x", at("2023-01-20"))], "id string, at timestamp_ntz").write.mode("append").parquet(f"{folder}/chunk_start=2023-01-19")
    with pytest.raises(SchemaMismatch):
        HotTable.adopt_chunks(spark, f"{world.root}/hot/t", folder, "at", "week")


def test_adopted_folders_must_be_chunks(spark, world):
    folder = f"{world.root}/raw"
    _weeks(spark, folder, at("2023-01-12"))
    with pytest.raises(RetentionError, match="month"):
        HotTable.adopt_chunks(spark, f"{world.root}/hot/t", folder, "at", "month")
    astray = spark.createDataFrame([(1, at("2023-01-13"))], "id long, at timestamp_ntz")
    astray.write.mode("append").parquet(f"{folder}/chunk_start=2023-01-05")
    with pytest.raises(RetentionError, match="other chunks"):
        HotTable.adopt_chunks(spark, f"{world.root}/hot/t", folder, "at", "week")
    spark.createDataFrame([(1, at("2023-01-23"))], "id long, at timestamp_ntz").write.parquet(f"{folder}/chunk_start=2023-01-23")
    with pytest.raises(RetentionError):
        HotTable.adopt_chunks(spark, f"{world.root}/hot/t", folder, "at", "week")


def test_append_widens_the_table(spark, world):
    hot = world.load(small_orders(spark), ORDERS_RULE)
    hot.append(small_orders(spark).filter("id = 1").withColumn("id", F.lit(50)).withColumn("extra", F.lit("e")).drop("notes"))
    assert hot.schema().fieldNames()[-1] == "extra" and hot.count() == 9
    assert [(r["extra"], r["notes"]) for r in hot.df().filter("id in (1, 50)").orderBy("id").collect()] == [(None, "first"), ("e", None)]
    with pytest.raises(SchemaMismatch):
        hot.append(small_orders(spark).withColumn("id", F.col("id").cast("string")))


def test_weeks_from_any_day():
    for later in range(7):
        unit = f"week+{later}" if later else "week"
        start = chunks.boundary(at("2023-05-17 11:00"), unit)
        assert start.weekday() == later and 0 <= (at("2023-05-17") - start).days < 7
        assert chunks.unit_of("week", [start.date()]) == unit


def test_same_run_id_with_another_cutoff_is_refused(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, at("2023-03-15"), "0000000a")
    with pytest.raises(RunExists):
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")


def test_rows_that_were_not_archived_as_they_are_stay(spark, world):
    for unit in (None, "month"):
        hot = {"orders": world.load(small_orders(spark), ORDERS_RULE, unit, name=f"o-{unit}")}
        run = f"run-{unit}"
        archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, run, purge=False)
        hot["orders"].append(small_orders(spark).filter("id in (1, 2)").withColumn("notes", F.lit("other")))
        [told] = archive.purge_run(world.store, rule(ORDERS_RULE), hot, AS_OF, run, world.history).collect()
        assert (told["rows_deleted"], told["rows_kept"]) == (5, 2)
        left = hot["orders"].df().filter("id < 6").collect()
        assert sorted((r["id"], r["notes"]) for r in left) == [(1, "other"), (2, "other")]
        world.store.delete(world.store.runs("testdb", "orders")[0])
    assert {e["event_type"] for e in world.history.df().collect()} == {"purge"}


def test_purge_of_a_table_in_one_piece_rewrites_only_files_with_expired_rows(spark, world):
    rows = small_orders(spark).withColumn("part", F.when(F.col("created_at") < AS_OF - timedelta(days=30), 0).otherwise(1))
    folder = f"{world.root}/with space/raw"
    for part in (0, 1):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    hot = {"orders": HotTable.adopt(spark, f"{world.root}/hot/with space", [folder])}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    files = [f for f in hot["orders"].df().inputFiles() if "raw" in f]
    assert len(files) == 1 and rows_of(hot["orders"].df()) == rows_of(rows.filter("part = 1").drop("part"))
    # files of the table's own folders are named one by one, and their folder outlives a vacuum
    old = rows.filter("id = 1").drop("part").withColumn("id", F.lit(70))
    hot["orders"].append(old.unionByName(rows.filter("id = 7").drop("part").withColumn("id", F.lit(71))).repartition(2, "id"))
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000b")
    hot["orders"].vacuum()
    assert sorted(r["id"] for r in hot["orders"].df().collect()) == [6, 7, 8, 71]
