from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from coldkeep import KeyAuditFailed, NoArchiveFiles, RestoreConflict, SchemaMismatch, Selection, UnknownTable
from coldkeep.operators import restore as ops
from coldkeep.plans import archive, restore
from tests.conftest import AS_OF, ORDERS_RULE, rows_of, rule, small_orders

EARLIER = AS_OF - timedelta(days=290)  # cutoff 2023-02-15: one row


def two_runs(spark, world, **options):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE, **options), world.store, hot, EARLIER, "0000000a")
    archive.archive_rule(spark, rule(ORDERS_RULE, **options), world.store, hot, AS_OF, "0000000b")
    return hot


def ids(hot):
    return sorted(r["id"] for r in hot["orders"].df().collect())


@pytest.mark.parametrize("selection, want", [
    (Selection(run_id="0000000a"), [1, 6, 7, 8]),
    (Selection(cutoff_date="2023-12-02"), [2, 3, 4, 5, 6, 7, 8]),
    (Selection(), [1, 2, 3, 4, 5, 6, 7, 8]),
])
def test_restore_selected(spark, world, selection, want):
    hot = two_runs(spark, world)
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, selection, world.history)
    assert ids(hot) == want
    event = world.history.df().first()
    assert (event["run_id"], event["event_type"], event["row_count"]) == ("restore", "restore", len(want) - 3)


def test_restore_errors(spark, world):
    hot = two_runs(spark, world)
    with pytest.raises(UnknownTable):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, Selection(table="nope"))
    with pytest.raises(NoArchiveFiles):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, Selection(run_id="ffffffff"), world.history)
    assert [(e["status"], e["row_count"]) for e in world.history.df().collect()] == [("error", 0)]


def test_second_restore_collides(spark, world):
    hot = two_runs(spark, world)
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, Selection(run_id="0000000a"))
    with pytest.raises(RestoreConflict):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    assert ids(hot) == [1, 6, 7, 8]
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, on_conflict="skip")
    assert rows_of(hot["orders"].df()) == rows_of(small_orders(spark))
    with pytest.raises(ValueError):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, on_conflict="replace")


def test_rows_archived_twice(spark, world):
    """A restored row expires again; its two copies collide, or the earlier one wins."""
    hot = two_runs(spark, world)
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, Selection(run_id="0000000a"))
    changed = hot["orders"].df().withColumn("notes", F.when(F.col("id") == 1, "changed").otherwise(F.col("notes")))
    hot = {"orders": world.load(changed, ORDERS_RULE, name="changed")}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF + timedelta(days=1), "0000000c")
    with pytest.raises(RestoreConflict):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, on_conflict="skip")
    assert rows_of(hot["orders"].df()) == rows_of(small_orders(spark))


def test_preview_counts_without_a_table(spark, world):
    two_runs(spark, world, batch_size=1)
    shown = restore.preview_restore(world.store, rule(ORDERS_RULE)).first()
    assert (shown["table_name"], shown["files"], shown["rows"]) == ("orders", 5, 5)
    one = restore.preview_restore(world.store, rule(ORDERS_RULE), Selection(run_id="0000000b")).first()
    assert (one["files"], one["rows"]) == (4, 4)
    # without a manifest the footers are counted
    [run] = world.store.runs("testdb", "orders", Selection(run_id="0000000b"))
    world.store.files.delete(world.store.run_manifest_path(run))
    shown = restore.preview_restore(world.store, rule(ORDERS_RULE)).first()
    assert (shown["files"], shown["rows"]) == (5, 5)


def test_older_schema(spark, world):
    old = small_orders(spark).drop("notes")
    hot = {"orders": world.load(old, ORDERS_RULE, name="old")}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, EARLIER, "0000000a")
    current = small_orders(spark).filter("id > 1").withColumn("id", F.col("id").cast("bigint"))
    hot = {"orders": world.load(current, ORDERS_RULE)}
    restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    back = hot["orders"].df().filter("id = 1").first()
    assert back["notes"] is None and back["customer"] == "a"
    assert hot["orders"].df().schema["id"].dataType.simpleString() == "bigint"


def test_archive_that_does_not_fit(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE, name="wide")}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    for name, shape in (
        ("dropped", small_orders(spark).drop("notes")),
        ("narrow", small_orders(spark).withColumn("amount", F.col("amount").cast("decimal(5,2)"))),
    ):
        narrow = {"orders": world.load(shape.filter("id > 5"), ORDERS_RULE, name=name)}
        with pytest.raises(SchemaMismatch):
            restore.restore_rule(spark, rule(ORDERS_RULE), world.store, narrow, AS_OF)
        assert narrow["orders"].count() == 3


def test_nested_columns_round_trip(spark, world):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn(
        "created_at", F.timestamp_seconds(F.col("vec_id") * 86_400).cast("timestamp_ntz")
    )
    from coldkeep import TableRule

    table = TableRule("embeddings", "created_at", 30, ("vec_id",))
    for encoding in ("native", "canonical"):
        hot = {"embeddings": world.load(rows, table, name=f"e-{encoding}")}
        plan = rule(table, encoding=encoding)
        store = type(world.store)(spark, f"{world.root}/archive-{encoding}")
        archive.archive_rule(spark, plan, store, hot, AS_OF, "0000000a")
        assert hot["embeddings"].count() == 0
        restore.restore_rule(spark, plan, store, hot, AS_OF)
        assert hot["embeddings"].df().exceptAll(rows).count() == 0 and hot["embeddings"].count() == rows.count()


def test_hot_key_is_picked_once(spark):
    """A key archived very often is reduced before the shuffle, not gathered."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v", "cast(id as string) as run")
    picked = ops.first_archived(rows.withColumn("o", F.col("v")), ["k"], ["o"])
    assert picked.count() == 2001 and picked.filter("k = 0").first()["v"] == 0
    plan = picked._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_key_audit_on_given_table(spark):
    from coldkeep.operators.keys import audit_key

    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    with pytest.raises(KeyAuditFailed, match="1161 keys shared by 2562 rows"):
        audit_key(items, ["l_orderkey", "l_linenumber"], "lineitem")
    with pytest.raises(KeyAuditFailed, match="do not exist"):
        audit_key(items, ["nope"], "lineitem")
