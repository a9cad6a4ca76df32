"""Hash trees, row group digests and chunks with any bounds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coldkeep.model import RetentionError
from coldkeep.operators import hash_tree, intervals, row_groups
from coldkeep.operators.hash_tree import differing_leaves, differing_rows, leaves
from coldkeep.operators.intervals import Interval, checked, droppable_intervals, interval_index, interval_inventory
from coldkeep.plans import archive
from coldkeep.sources.archive_store import ArchiveStore
from tests.conftest import AS_OF, ORDERS_RULE, at, rows_of, rule, small_orders


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a int, b string, v double")


def test_differing_rows_to_the_row(spark):
    rows = [(i, f"k{i % 7}", float(i)) for i in range(300)] + [(None, "n", 1.0), (1, None, 2.0), (5, "twice", 1.0), (5, "twice", 1.0)]
    other = [r for r in rows if r != (3, "k3", 3.0)] + [(None, None, None), (5, "twice", 1.0)]
    other = [(a, b, None if a == 10 else v) for a, b, v in other]
    random.Random(1).shuffle(other)
    found = differing_rows(spark, pairs(spark, rows), pairs(spark, other).select("v", "a", "b"), ["a", "b"])
    assert rows_of(found) == sorted([(3, 0, "k3", 1, "missing"), (None, 1, None, 0, "extra"), (5, 3 - 2, "twice", 0, "extra"),
                                     (10, 1, "k3", 1, "changed")], key=repr)


def test_equal_tables_shuffle_no_row(spark, monkeypatch):
    rows = [(i, "x", 1.5) for i in range(200)]
    one, two = pairs(spark, rows), pairs(spark, rows[::-1]).repartition(5)
    trees = leaves(spark, one, ["a"]), leaves(spark, two, ["a"])
    assert differing_leaves(spark, *trees).count() == 0
    # nothing but the trees is looked at
    monkeypatch.setattr(hash_tree, "row_hash", lambda schema: pytest.fail("rows are read"))
    found = differing_rows(spark, one, two, ["a"], *trees)
    assert found.collect() == [] and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_differing_leaves_are_compared(spark):
    rows = [(i, "x", 1.5) for i in range(2000)]
    one, two = pairs(spark, rows), pairs(spark, [*rows[:7], (7, "x", 2.5), *rows[8:]])
    kept = leaves(spark, one, ["a"])
    found = differing_rows(spark, one, two, ["a"], expected_tree=kept)
    assert rows_of(found) == [(7, 1, 1, "changed")]
    assert differing_leaves(spark, kept, leaves(spark, two, ["a"])).count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_row_groups_locate_damage(spark, world):
    store = ArchiveStore(spark, world.store.root, write_options={"parquet.block.size": "2048"})
    wide = spark.range(4000).selectExpr("cast(id as int) id", "cast('2023-01-01' as timestamp_ntz) created_at", "md5(cast(id as string)) s")
    hot = {"orders": world.load(wide.coalesce(1), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE, batch_size=2000), store, hot, AS_OF, "0000aaaa")
    runs = store.runs("testdb", "orders")
    row_groups.record_row_groups(store, runs)
    recorded = row_groups.recorded_row_groups(store, runs)
    told = {(r["file_name"], r["row_group"]): r for r in recorded.collect()}
    files = sorted({f for f, _ in told})
    assert len(files) == 2 and len(told) > 8
    assert row_groups.run_digests(recorded).first()["rows"] == 4000 and row_groups.file_digests(recorded).count() == 2
    first = row_groups.verify_row_groups(store, runs)
    assert {(r["status"], r["read"]) for r in first.collect()} == {("OK", True)}
    assert not row_groups.verify_row_groups(store, runs, first).filter("read").count()
    # one bit of a late group, and the end of another file
    last = max(g for f, g in told if f == files[0])
    spot, path = told[files[0], last], f"{store.run_path(runs[0])}/{files[0]}"
    data = bytearray(store.files.read_bytes(path))
    data[spot["first_byte"] + 5] ^= 4
    store.files.write_bytes(path, data)
    second = row_groups.verify_row_groups(store, runs, first)
    assert [(r["file_name"], r["row_group"]) for r in second.filter("status = 'CORRUPT'").collect()] == [(files[0], last)]
    assert {r["file_name"] for r in second.filter("read").collect()} == {files[0]}  # the other file was not opened
    path = f"{store.run_path(runs[0])}/{files[1]}"
    store.files.write_bytes(path, store.files.read_bytes(path)[:-20])
    third = row_groups.verify_row_groups(store, runs, second)
    assert [r["row_group"] for r in third.filter(F.col("file_name") == files[1]).filter("status = 'CORRUPT'").collect()] == [row_groups.FOOTER]
    store.files.delete(path)
    assert {r["status"] for r in row_groups.verify_row_groups(store, runs, third).filter(F.col("file_name") == files[1]).collect()} == {"MISSING"}
    assert row_groups.verify_row_groups(store, []).count() == 0


def test_bounds_are_checked():
    one, two = Interval("a", at("2024-01-01"), at("2024-01-05")), Interval("b", at("2024-01-05"), at("2024-01-09"))
    assert checked([two, one]) == [one, two]
    for bad in ([one, Interval("b", at("2024-01-04 23:59"), at("2024-01-09"))], [one, Interval("c", at("2024-02-01"), at("2024-02-01"))],
                [one, two._replace(name="a")], []):
        with pytest.raises(RetentionError):
            checked(bad)


@pytest.mark.parametrize("tree", [256, 4])
def test_rows_find_their_interval(spark, monkeypatch, tree):
    monkeypatch.setattr(intervals, "TREE", tree)
    rng, start, found = random.Random(tree), datetime(2024, 1, 1), []
    for n in range(37):
        end = start + timedelta(minutes=rng.randrange(1, 4000))
        found.append(Interval(f"c{n:02}", start, end))
        start = end + timedelta(minutes=rng.choice((0, 0, rng.randrange(1, 500))))
    edges = [t + d for i in found for t in (i.start, i.end) for d in (-timedelta(microseconds=1), timedelta(0), timedelta(microseconds=1))]
    rows = spark.createDataFrame([(t,) for t in [*edges, None, datetime(1999, 1, 1), datetime(2999, 1, 1)]], "t timestamp_ntz")
    got = rows.select("t", interval_index(rows, "t", found).alias("i")).collect()
    want = {t: next((n for n, i in enumerate(found) if i.start <= t < i.end), None) for t in edges}
    assert all(r["i"] == want.get(r["t"]) for r in got)


def test_intervals_drop_only_what_is_archived(spark):
    orders = small_orders(spark)
    bounds = [Interval("q1", at("2023-01-01"), at("2023-03-20")), Interval("q2", at("2023-03-20"), at("2023-06-01")),
              Interval("none", at("2023-07-01"), at("2023-08-01")), Interval("new", at("2023-12-01"), at("2024-02-01"))]
    told = interval_inventory(orders, "created_at", bounds, at("2023-12-02"))
    assert rows_of(told.select("name", "rows", "expired")) == sorted(
        [(True, "q1", 3), (True, "q2", 2), (True, "none", 0), (False, "new", 3)], key=repr)
    archived = orders.filter("id <> 4")
    dropped = droppable_intervals(orders, archived, "created_at", bounds, at("2023-12-02"))
    assert rows_of(dropped) == [("none", 0), ("q1", 3)]
    assert droppable_intervals(orders, orders, "created_at", bounds, at("2020-01-01")).collect() == []
    text = orders.filter(intervals.in_intervals(orders, "created_at", bounds[:2])).select("id")
    assert [r[0] for r in text.orderBy("id").collect()] == [1, 2, 3, 4, 5]
