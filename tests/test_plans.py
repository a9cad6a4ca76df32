"""The physical plans are the ones a huge table needs."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from coldkeep import TableRule
from coldkeep.functions.digest import content_totals
from coldkeep.operators import expire, reports
from coldkeep.operators.restore import conflicts_with_hot, key_counts
from coldkeep.plans import archive, restore
from coldkeep.session import workspace
from coldkeep.sources.archive_store import Run
from coldkeep.sources.hot_table import HotTable
from tests.conftest import AS_OF, SENSOR_RULE, SF, at, rule, small_sensors

CUTOFF = at("1997-01-01")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_expiry_filter_reaches_the_scan(spark):
    text = plan(expire.expired(orders(spark), "o_orderdate", CUTOFF))
    assert "LessThan(o_orderdate" in text and "Exchange" not in text


def test_date_only_cutoff_reaches_the_scan(spark, tmp_path):
    orders(spark).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).write.parquet(f"{tmp_path}/d")
    assert "LessThan(d," in plan(expire.expired(spark.read.parquet(f"{tmp_path}/d"), "d", CUTOFF))


def test_preview_reads_the_date_column_only(spark):
    text = plan(expire.preview([("orders", orders(spark), "o_orderdate", CUTOFF)]))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text and "partial_count" in text


def test_expired_keys_read_two_columns(spark):
    text = plan(expire.expired_keys(orders(spark), "o_orderdate", CUTOFF, ["o_orderkey"]))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_key_digest_shuffles_one_row_per_task(spark):
    text = plan(content_totals(orders(spark), ["o_orderkey"]))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    assert "partial_sum" in text and "Sort" not in text


def test_kept_rows_are_copied_without_shuffle(spark):
    text = plan(expire.unexpired(orders(spark), "o_orderdate", CUTOFF))
    assert "Exchange" not in text


def test_recent_is_a_top_n(spark):
    history = spark.range(100).selectExpr("id", "'r' as rule", "timestamp_seconds(id) as start_time")
    text = plan(reports.recent(history, "r"))
    assert "TakeOrderedAndProject" in text


def test_conflict_check_reads_keys_only(spark):
    counts = key_counts(spark, orders(spark), ["o_orderkey"])
    text = plan(conflicts_with_hot(counts, orders(spark), ["o_orderkey"]))
    assert "o_totalprice" not in text and "BroadcastHashJoin LeftSemi" in text


def test_chunked_scan_skips_later_chunks(spark, world):
    hot = world.load(small_sensors(spark), SENSOR_RULE, "month")
    files = hot.expired("time", at("2023-02-15")).inputFiles()
    assert files and all("chunk_start=2023-01" in f or "chunk_start=2023-02" in f for f in files)


def test_conflict_check_skips_later_chunks_when_the_key_has_the_date(spark, world):
    hot = world.load(small_sensors(spark), SENSOR_RULE, "month")
    runs = [Run("testdb", "sensor_data", "2023-02-15", "0000000a")]
    rows = restore._rows_that_could_clash(hot, SENSOR_RULE, runs)
    assert all("chunk_start=2023-01" in f or "chunk_start=2023-02" in f for f in rows.inputFiles())
    plain = TableRule("sensor_data", "time", 30, ("sensor_id",))
    assert restore._rows_that_could_clash(hot, plain, runs).count() == 10


def test_clean_purge_joins_nothing(spark, world, monkeypatch):
    """Counts and digests agree, so the join is never planned."""
    def refuse(*_):
        raise AssertionError("late_rows was called")

    monkeypatch.setattr(archive, "late_rows", refuse)
    hot = {"sensor_data": world.load(small_sensors(spark), SENSOR_RULE)}
    done = archive.archive_rule(spark, rule(SENSOR_RULE), world.store, hot, AS_OF, "0000000a").first()
    assert done["key_deleted"] == 7


def test_workspace_is_shared_storage(spark):
    assert workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/coldkeep/x-")
    assert workspace(spark, "x") != workspace(spark, "x")


def test_rewritten_chunk_is_not_shuffled(spark, world):
    """Rows of a boundary chunk go from its old folder to its new one."""
    hot = world.load(small_sensors(spark), SENSOR_RULE, "year")
    frames = []
    write = hot.write_parts
    hot.write_parts = lambda df, *rest: frames.append(df) or write(df, *rest)
    done = archive.archive_rule(spark, rule(SENSOR_RULE), world.store, {"sensor_data": hot}, AS_OF, "0000000a").first()
    assert (done["chunks_dropped"], done["key_deleted"]) == (0, 7)
    assert "Exchange" not in plan(frames[0])


def test_hot_chunk_is_written_by_many_tasks(spark, world):
    """One chunk holds nearly all rows; ranges over chunk and date split it."""
    rows = spark.range(40_000).select(
        "id", (F.lit("2023-06-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("at")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = HotTable.load(spark, f"{world.root}/hot/skew", rows, "at", "month", ("id",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot.snapshot().parts) == 1 and len(hot.df().inputFiles()) == 4
