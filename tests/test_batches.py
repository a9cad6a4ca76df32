import pytest
from pyspark.sql import functions as F

from coldkeep.operators import batches


def skewed(spark):
    """Two-part key; a third of the rows share one value of the leading part."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919) % 500).alias("a"), F.col("id").alias("b")
    ).repartition(5)


def test_ordinals_follow_the_key(spark):
    rows = batches.with_ordinal(spark, skewed(spark), ["a", "b"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(3000))
    assert [(r["a"], r["b"]) for r in rows] == sorted((r["a"], r["b"]) for r in rows)


def test_ordinals_with_many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = batches.batch_plan(spark, skewed(spark), ["a", "b"], 700).orderBy("batch").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["batch"], r["batch_name"], r["rows"]) for r in plan] == [
        (0, "000", 700), (1, "001", 700), (2, "002", 700), (3, "003", 700), (4, "004", 200)
    ]
    for before, after in zip(plan, plan[1:]):
        assert (before["last_a"], before["last_b"]) < (after["first_a"], after["first_b"])


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_batches_fill_every_file(spark, tmp_path, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = batches.in_exact_batches(spark, skewed(spark), ["a", "b"], 70, rows_per_task=200)
        rows.write.option("maxRecordsPerFile", 70).parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/out").groupBy("_metadata.file_name").count().collect()
    assert sorted(r["count"] for r in files) == [60] + [70] * 42


def test_running_starts(spark):
    amounts = spark.createDataFrame([(2, 5), (0, 3), (10, 4)], "_part long, _amount long")
    assert sorted(tuple(r) for r in batches.running_starts(spark, amounts).collect()) == [(0, 0), (2, 3), (10, 8)]
    assert batches.running_starts(spark, amounts.filter("_part > 99")).count() == 0


def test_no_rows_have_no_batches(spark):
    assert batches.batch_plan(spark, skewed(spark).filter("a > 1000"), ["a", "b"], 10).count() == 0
