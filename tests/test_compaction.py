import glob
import os

import pytest

from coldkeep.model import Selection
from coldkeep.operators.row_groups import record_row_groups, recorded_row_groups
from coldkeep.plans.archive import archive_rule
from coldkeep.plans.compaction import compact_rule, recover_compactions
from coldkeep.plans.verify import verify_rule
from tests.conftest import AS_OF, ORDERS_RULE, ITEMS_RULE, rows_of, rule, small_items, small_orders


@pytest.fixture
def archived(spark, world):
    """Five orders in files of one row each, and items."""
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE), "order_items": world.load(small_items(spark), ITEMS_RULE)}
    both = rule(ORDERS_RULE, ITEMS_RULE, batch_size=1)
    archive_rule(spark, both, world.store, hot, AS_OF, "00aa", world.history)
    return both


def files_of(world, table="orders"):
    return sorted(glob.glob(world.local(f"{world.store.root}/testdb/{table}/*/*/*.parquet")))


def archive_of(world):
    [rows] = world.store.read(world.store.runs("testdb", "orders"))
    return rows_of(rows)


def actions(df):
    return {r.table_name: (r.action, r.files_before, r.files_after, r.rows) for r in df.collect()}


def test_few_files_same_rows(spark, world, archived):
    run = world.store.runs("testdb", "orders")
    before, published = archive_of(world), world.store.manifest(run).first().published_at
    record_row_groups(world.store, run)
    assert len(files_of(world)) == 5
    done = actions(compact_rule(spark, archived, world.store))
    # the writer may leave a file without rows for an empty first task
    assert done == {"orders": ("compacted", 5, 1, 5), "order_items": ("compacted", done["order_items"][1], 1, 5)}
    assert len(files_of(world)) == 1 and archive_of(world) == before
    assert world.store.manifest(run).first().published_at == published
    assert recorded_row_groups(world.store, run).collect() == []
    assert {(r.table_name, r.status) for r in verify_rule(spark, archived, world.store).collect()} == {("orders", "OK"), ("order_items", "OK")}
    world.store.check_complete(run)
    assert actions(compact_rule(spark, archived, world.store)) == {"orders": ("unchanged", 1, 1, 5), "order_items": ("unchanged", 1, 1, 5)}


def test_bytes_decide_how_many(spark, world, archived):
    sizes = [os.path.getsize(f) for f in files_of(world)]
    small = compact_rule(spark, archived, world.store, max(sizes) + 10, Selection(table="orders"))
    assert actions(small) == {"orders": ("unchanged", 5, 5, 5)}
    pairs = compact_rule(spark, archived, world.store, 2 * max(sizes) + 50, Selection(table="orders"))
    # five files of about the same size, two to a bin
    assert actions(pairs)["orders"][2] in (3, 5)
    with pytest.raises(ValueError):
        compact_rule(spark, archived, world.store, 0)


@pytest.mark.parametrize("harm, action", [("lost", "damaged"), ("garbage", "failed")])
def test_damaged_runs_stay(spark, world, archived, harm, action):
    path = files_of(world)[2]
    if harm == "lost":
        os.remove(path)
    else:
        with open(path, "wb") as f:
            f.write(b"no parquet file")
    left = {f: open(f, "rb").read() for f in files_of(world)}
    report = compact_rule(spark, archived, world.store)
    done = {r.table_name: (r.action, r.error) for r in report.collect()}
    assert done["orders"][0] == action and done["orders"][1]
    assert done["order_items"] == ("compacted", None)
    assert {f: open(f, "rb").read() for f in files_of(world)} == left
    assert not world.store.files.glob(f"{world.store.root}/_compacting/*/*/*/*")


def test_runs_without_a_manifest_stay(spark, world, archived):
    [run] = world.store.runs("testdb", "orders")
    world.store.files.delete(world.store.run_manifest_path(run))
    assert actions(compact_rule(spark, archived, world.store, selection=Selection(table="orders"))) == {}
    assert len(files_of(world)) == 5


class Died(Exception):
    pass


# before: the check is noted, the new rows move, the manifest goes, the new manifest moves, the working folder goes
@pytest.mark.parametrize("step", [1, 3, 5, 6, 7])
def test_any_interruption_can_be_recovered(spark, world, archived, monkeypatch, step):
    """The driver dies before one of the calls that change folders: nothing is lost, and a repeat finishes."""
    before, only = archive_of(world), Selection(table="orders")
    left = [step]
    files = type(world.store.files)

    def dying(patched, name):
        real = getattr(files, name)

        def call(self, *args, **kw):
            if left[0] == 0:
                raise Died
            left[0] -= 1
            return real(self, *args, **kw)

        patched.setattr(files, name, call)

    with monkeypatch.context() as patched:
        for name in ("rename", "delete", "write_text"):
            dying(patched, name)
        with pytest.raises(Died):
            compact_rule(spark, archived, world.store, selection=only)
    recover_compactions(world.store)
    assert archive_of(world) == before
    world.store.check_complete(world.store.runs("testdb", "orders"))
    assert {r.status for r in verify_rule(spark, archived, world.store, only).collect()} == {"OK"}
    compact_rule(spark, archived, world.store, selection=only)
    assert len(files_of(world)) == 1 and archive_of(world) == before
    assert recover_compactions(world.store) == ([], [])
