import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coldkeep import ArchiveIncomplete, NoArchiveFiles, Selection, TableRule, UnknownTable
from coldkeep.operators import reports
from coldkeep.operators.verify import totals
from coldkeep.plans import archive, restore
from coldkeep.plans.verify import verify_against_history, verify_rule
from coldkeep.streaming import verify_stream
from tests.conftest import AS_OF, ORDERS_RULE, rule, small_orders

WIDE = TableRule("wide", "at", 30, ("id",))


def archived(spark, world, rows=20_000, run_id="0000000a", parts=1):
    """Archive one run in files with many small row groups; returns the paths of its files."""
    df = spark.range(rows).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.rand(3).alias("x"),
        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("at"),
    )
    hot = {"wide": world.load(df, WIDE, name=f"wide-{run_id}")}
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        plan = rule(WIDE, batch_size=rows // parts)
        archive.archive_rule(spark, plan, world.store, hot, AS_OF, run_id, world.history, order="exact")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    [run] = world.store.runs("testdb", "wide", Selection(run_id=run_id))
    folder = world.local(world.store.run_path(run))
    return [f"{folder}/{n}" for n in sorted(os.listdir(folder)) if n.endswith(".parquet")]


def drop_checksum(path):
    """Local files carry a checksum of their own; without it only the content can tell."""
    folder, name = os.path.split(path)
    crc = f"{folder}/.{name}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def rewrite(path, change):
    with open(path, "rb") as f:
        content = bytearray(f.read())
    content = change(content)
    with open(path, "wb") as f:
        f.write(content)
    drop_checksum(path)


def flip_first_page(content):
    content[40:80] = bytes(b ^ 0xFF for b in content[40:80])
    return content


def flip_late_group(path):
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups > 4
    column = meta.row_group(meta.num_row_groups - 1).column(1)
    start = column.data_page_offset + 20

    def change(content):
        content[start:start + 40] = bytes(b ^ 0xFF for b in content[start:start + 40])
        return content

    rewrite(path, change)


def flip_one_bit(path):
    """Change a stored value without touching anything that would fail to decode."""
    table = pq.read_table(path)
    values = table.column("x").to_pylist()
    import struct

    needle = struct.pack("<d", values[17])

    def change(content):
        at = content.find(needle)
        assert at > 0
        content[at] ^= 1
        return content

    rewrite(path, change)


def statuses(df):
    return {r["run_id"]: (r["status"], r["rows"]) for r in df.collect()}


def test_damage_matrix(spark, world):
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        paths = {run: archived(spark, world, run_id=run)[0] for run in (
            "sound", "firstpage", "lategroup", "onebit", "half", "text", "zero", "lost")}
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    rewrite(paths["firstpage"], flip_first_page)
    flip_late_group(paths["lategroup"])
    flip_one_bit(paths["onebit"])
    rewrite(paths["half"], lambda c: c[: len(c) // 2])
    rewrite(paths["text"], lambda c: bytearray(b"this is not a parquet file"))
    rewrite(paths["zero"], lambda c: bytearray())
    os.remove(paths["lost"])
    # a reader that skips damage would take the flipped bit for good
    assert spark.read.parquet(paths["onebit"]).count() == 20_000
    found = verify_rule(spark, rule(WIDE), world.store)
    assert statuses(found) == {
        "sound": ("OK", 20_000), "firstpage": ("CORRUPT", 0), "lategroup": ("CORRUPT", 0), "onebit": ("CORRUPT", 0),
        "half": ("CORRUPT", 0), "text": ("CORRUPT", 0), "zero": ("CORRUPT", 0), "lost": ("MISSING", 0),
    }
    counted = totals(found).first()
    assert (counted["ok_files"], counted["corrupt_files"], counted["missing_files"], counted["rows"]) == (1, 6, 1, 20_000)


def test_without_manifest(spark, world):
    """Files nobody recorded: footer against decode, and zero-row files opened one by one."""
    paths = {run: archived(spark, world, run_id=run)[0] for run in ("sound", "lategroup", "text", "zero", "norows")}
    shutil.rmtree(world.local(world.store.manifest_path("testdb", "wide")))
    flip_late_group(paths["lategroup"])
    rewrite(paths["text"], lambda c: bytearray(b"this is not a parquet file"))
    rewrite(paths["zero"], lambda c: bytearray())
    schema = pq.read_schema(paths["norows"])
    pq.write_table(pa.table({f.name: pa.array([], f.type) for f in schema}), paths["norows"])
    drop_checksum(paths["norows"])
    world.store._schemas.clear()
    assert statuses(verify_rule(spark, rule(WIDE), world.store)) == {
        "sound": ("OK", 20_000), "lategroup": ("CORRUPT", 0), "text": ("CORRUPT", 0), "zero": ("CORRUPT", 0), "norows": ("OK", 0),
    }


def test_stray_files_are_not_read(spark, world):
    path = archived(spark, world, rows=100)[0]
    shutil.copy(path, path + ".pending")
    assert statuses(verify_rule(spark, rule(WIDE), world.store)) == {"0000000a": ("OK", 100)}
    shown = restore.preview_restore(world.store, rule(WIDE)).first()
    assert (shown["files"], shown["rows"]) == (1, 100)
    assert sum(df.count() for df in world.store.read(world.store.runs("testdb", "wide"))) == 100


def test_verify_errors(spark, world):
    with pytest.raises(NoArchiveFiles):
        verify_rule(spark, rule(ORDERS_RULE), world.store)
    with pytest.raises(UnknownTable):
        verify_rule(spark, rule(ORDERS_RULE), world.store, Selection(table="nope"))


def test_reconcile(spark, world):
    paths = {run: archived(spark, world, rows=100, run_id=run, parts=2) for run in ("match", "damaged", "gone")}
    rewrite(paths["damaged"][0], lambda c: bytearray(b"x"))
    for p in paths["gone"]:
        os.remove(p)
    history = world.history.df()
    full = verify_against_history(spark, rule(WIDE), world.store, history)
    assert {(r["run_id"], r["expected_rows"], r["actual_rows"], r["status"]) for r in full.collect()} == {
        ("match", 100, 100, "match"), ("damaged", 100, 50, "mismatch"), ("gone", 100, 0, "missing")}
    inner = verify_against_history(spark, rule(WIDE), world.store, history, full=False)
    assert sorted(r["status"] for r in inner.collect()) == ["match", "mismatch"]
    unknown = verify_against_history(spark, rule(WIDE), world.store, history.filter("run_id <> 'match'"))
    assert {r["run_id"]: r["status"] for r in unknown.collect()}["match"] == "unrecorded"
    one = verify_against_history(spark, rule(WIDE), world.store, history, Selection(run_id="match"))
    assert [r["status"] for r in one.collect()] == ["match"]
    by_date = verify_against_history(spark, rule(WIDE), world.store, history, Selection(cutoff_date="2023-12-02"))
    assert by_date.count() == 3


def test_stream_judges_each_file_once(spark, world):
    out, mark = f"{world.root}/verified", f"{world.root}/checkpoint"

    def step():
        verify_stream.verify_new_runs(spark, world.store, "testdb", "wide", out, mark)
        return {(r["run_id"], r["status"], r["rows"], r["batch_id"]) for r in verify_stream.verified(spark, out).collect()}

    archived(spark, world, rows=100, run_id="one")
    first = step()
    assert first == {("one", "OK", 100, "0")}
    broken = archived(spark, world, rows=100, run_id="two")[0]
    rewrite(broken, lambda c: c[: len(c) // 2])
    second = step()
    assert second == first | {("two", "CORRUPT", 0, "1")}
    # nothing new: nothing is judged again, although a verified file is now gone
    os.remove(broken)
    assert step() == second


def test_history_listing(spark, world):
    from coldkeep.sources.history import Event

    def event(run, name, kind, table, rows, status, error, minutes):
        from datetime import timedelta

        start = AS_OF - timedelta(minutes=minutes)
        return Event(run, name, kind, table, rows, ("a", "b"), status, error, start, start + timedelta(seconds=30))

    events = [
        event("run-001", "rule-a", "archive", "orders", 1000, "success", "", 10),
        event("run-002", "rule-b", "archive", "users", 500, "success", "", 5),
        event("run-003", "rule-a", "restore", "orders", 200, "error", "connection refused", 2),
        event("run-004", "rule-c", "archive", "x", 1, "success", "", 2),
    ]
    assert world.history.df().count() == 0
    world.history.record([])
    for e in events:
        world.history.record([e])
    everything = reports.recent(world.history.df()).collect()
    ids = [r["id"] for r in everything]
    assert ids == sorted(ids, reverse=True) and len(set(ids)) == 4
    assert [r["run_id"] for r in reports.recent(world.history.df(), "rule-a").collect()] == ["run-003", "run-001"]
    assert [r["run_id"] for r in reports.recent(world.history.df(), limit=1).collect()] == ["run-004"]
    assert reports.recent(world.history.df(), "nope").count() == 0
    first = reports.files_as_json(reports.with_duration(world.history.df())).filter("run_id = 'run-003'").first()
    assert (first["files"], first["duration_us"], first["error_message"]) == ('["a","b"]', 30_000_000, "connection refused")
    assert [r["run_id"] for r in reports.expected_rows(world.history.df()).orderBy("run_id").collect()] == ["run-001", "run-002", "run-004"]


def test_restore_refuses_lost_files(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    plan = rule(ORDERS_RULE, batch_size=2)
    archive.archive_rule(spark, plan, world.store, hot, AS_OF, "0000000a", order="exact")
    [run] = world.store.runs("testdb", "orders")
    folder = world.local(world.store.run_path(run))
    os.remove(f"{folder}/{min(n for n in os.listdir(folder) if n.endswith('.parquet'))}")
    with pytest.raises(ArchiveIncomplete):
        restore.restore_rule(spark, plan, world.store, hot, AS_OF)
    assert hot["orders"].count() == 3
    restore.restore_rule(spark, plan, world.store, hot, AS_OF, allow_incomplete=True)
    assert hot["orders"].count() == 6
    shutil.rmtree(folder)
    with pytest.raises(ArchiveIncomplete):
        restore.restore_rule(spark, plan, world.store, hot, AS_OF)
    with pytest.raises(NoArchiveFiles):
        restore.restore_rule(spark, plan, world.store, hot, AS_OF, allow_incomplete=True)


def test_restore_refuses_damage(spark, world):
    hot = {"orders": world.load(small_orders(spark), ORDERS_RULE)}
    archive.archive_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF, "0000000a")
    [run] = world.store.runs("testdb", "orders")
    folder = world.local(world.store.run_path(run))
    rewrite(f"{folder}/{[n for n in os.listdir(folder) if n.endswith('.parquet')][0]}", lambda c: c[: len(c) // 2])
    with pytest.raises(Exception):
        restore.restore_rule(spark, rule(ORDERS_RULE), world.store, hot, AS_OF)
    assert hot["orders"].count() == 3
