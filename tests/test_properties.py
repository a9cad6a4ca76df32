"""Properties over random small tables."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep import Rule, TableRule
from coldkeep.functions import numbers, timestamps
from coldkeep.operators import batches, chunks
from coldkeep.plans import archive, restore
from tests.conftest import AS_OF, World, ntz, rows_of

TABLE = TableRule("t", "at", 30, ("id", "part"))
SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("note", T.StringType()), ntz("at")])
FEW = {"max_examples": 6, "deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}

dates = st.one_of(st.none(), st.datetimes(datetime(2023, 9, 1), datetime(2024, 1, 1)))
tables = st.lists(
    st.tuples(st.integers(0, 5), st.integers(0, 5), st.one_of(st.none(), st.text("ab0'Z-:", max_size=4)), dates),
    max_size=25, unique_by=lambda r: r[:2],
)


@settings(**FEW)
@given(rows=tables, unit=st.sampled_from([None, "day", "week", "month"]), encoding=st.sampled_from(["native", "canonical"]))
def test_archive_then_restore_is_identity(spark, tmp_path, rows, unit, encoding):
    world = World(spark, tmp_path)
    original = spark.createDataFrame(rows, SCHEMA)
    hot = {"t": world.load(original, TABLE, unit)}
    rule = Rule("r", "db", (TABLE,), batch_size=4, encoding=encoding)
    cutoff = AS_OF - timedelta(days=30)
    old = [r for r in rows if r[3] is not None and r[3] < cutoff]
    done = archive.archive_rule(spark, rule, world.store, hot, AS_OF, "0000000a").first()
    assert (done["rows_archived"], done["chunk_deleted"] + done["key_deleted"]) == (len(old), len(old))
    assert rows_of(hot["t"].df()) == rows_of(spark.createDataFrame([r for r in rows if r not in old], SCHEMA))
    if old:
        restore.restore_rule(spark, rule, world.store, hot, AS_OF)
    assert rows_of(hot["t"].df()) == rows_of(original)


@settings(**FEW)
@given(keys=st.lists(st.integers(-50, 50), min_size=1, max_size=60, unique=True), size=st.integers(1, 9))
def test_batches_cover_the_keys_in_order(spark, keys, size):
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    plan = batches.batch_plan(spark, df, ["k"], size).orderBy("batch").collect()
    ordered = sorted(keys)
    parts = [ordered[i:i + size] for i in range(0, len(ordered), size)]
    assert [(r["rows"], r["first_k"], r["last_k"]) for r in plan] == [(len(p), p[0], p[-1]) for p in parts]


@settings(**FEW)
@given(values=st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50))
def test_wrapping_keeps_the_low_32_bits(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", numbers.wrap_int32(F.col("v")).alias("w"))
    for r in df.collect():
        assert r["w"] == (r["v"] + 2**31) % 2**32 - 2**31


@settings(**FEW)
@given(values=st.lists(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), min_size=1, max_size=50))
def test_time_text_round_trips(spark, values):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([ntz("v")]))
    kind = T.TimestampNTZType()
    text = df.select("v", timestamps.rfc3339(F.col("v"), kind).alias("t"))
    for r in text.select("v", "t", timestamps.parse_rfc3339(F.col("t"), kind).alias("b")).collect():
        assert r["b"] == r["v"] and datetime.fromisoformat(r["t"].removesuffix("Z")) == r["v"] and r["t"].endswith("Z")
        assert "." not in r["t"] or not r["t"].endswith("0Z")


@settings(**FEW)
@given(values=st.lists(st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), min_size=1, max_size=50),
       cutoff=st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), unit=st.sampled_from(["day", "week", "month", "year"]))
def test_boundary_agrees_with_chunk_ends(spark, values, cutoff, unit):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([ntz("v")]))
    for r in chunks.chunk_inventory(df, "v", unit, cutoff).collect():
        assert r["expired"] == (r["chunk_end"] <= cutoff)
