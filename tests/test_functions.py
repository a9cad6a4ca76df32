from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions import canonical, digest, names, numbers, timestamps
from coldkeep.operators import expire
from tests.conftest import at, ntz, rows_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("db_type, kind", [
    ("integer", "int32"), ("int4", "int32"), ("smallint", "int32"), ("bigint", "int64"), ("bigserial", "int64"),
    ("real", "float32"), ("double precision", "float64"), ("boolean", "bool"), ("text", "string"),
    ("character varying", "string"), ("bytea", "string"), ("timestamp without time zone", "string"),
    ("numeric", "string"), ("mediumint", "int32"), ("INTEGER", "string"),
])
def test_db_type_mapping(db_type, kind):
    assert canonical.canonical_of_db_type(db_type) == kind


def test_canonical_round_trip(spark):
    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("small", T.ShortType()), T.StructField("big", T.LongType()),
        T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(10, 2)),
        T.StructField("raw", T.BinaryType()), T.StructField("ok", T.BooleanType()), T.StructField("day", T.DateType()),
        ntz("at"), T.StructField("ratio", T.FloatType()), T.StructField("tags", T.ArrayType(T.StringType())),
    ])
    rows = [
        (1, 2, 3, "2024-01-01T00:00:00Z", Decimal("0.10"), b"abc", True, date(2023, 1, 15), at("2023-01-15 10:00:00.5"), 1.5, ["a"]),
        (2, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    encoded = canonical.encode(df)
    assert {f.dataType.simpleString() for f in encoded.schema.fields} <= {"int", "bigint", "float", "double", "boolean", "string"}
    first = encoded.filter("id = 1").first()
    assert (first["amount"], first["day"], first["at"]) == ("0.10", "2023-01-15T00:00:00Z", "2023-01-15T10:00:00.5Z")
    # Text that looks like a time stays text.
    assert rows_of(canonical.decode(encoded, schema)) == rows_of(df)


def test_narrowing(spark):
    assert one(spark, numbers.wrap_int32(F.lit(5_000_000_000))) == 705_032_704
    assert one(spark, numbers.wrap_int32(F.lit(2**63 - 1))) == -1
    assert one(spark, numbers.truncate_to_int64(F.lit(-2.9))) == -2
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        canonical.encode_as(spark.sql("select 5000000000L as x"), {"x": "integer"}).collect()


def test_format_count(spark):
    got = [one(spark, numbers.format_count(F.lit(n))) for n in (0, 999, 1000, 1234567)]
    assert got == ["0", "999", "1,000", "1,234,567"]


def test_names(spark):
    assert names.sanitize("my db/№1.x-y_z") == "my_db__1_x-y_z"
    assert one(spark, names.sanitized(F.lit("my db/№1.x-y_z"))) == "my_db__1_x-y_z"
    key = F.lit("db/t/2025-01-01/run11111_000.parquet")
    assert one(spark, names.key_run_id(key)) == "run11111"
    assert one(spark, names.key_run_id(F.lit("db/a_b/plain.parquet"))) == ""
    assert one(spark, names.key_mentions(key, F.lit("11111"))) is True
    assert one(spark, names.key_mentions(key, F.lit(""))) is False


def test_rfc3339(spark):
    for text, want in [("2023-01-15 10:00:00", "2023-01-15T10:00:00Z"), ("2023-01-15 10:00:00.120000", "2023-01-15T10:00:00.12Z")]:
        for kind in (T.TimestampNTZType(), T.TimestampType()):
            assert one(spark, timestamps.rfc3339(F.lit(text).cast(kind), kind)) == want
    parsed = one(spark, timestamps.parse_rfc3339(F.lit("2023-01-15T12:00:00+02:00"), T.TimestampNTZType()))
    assert parsed == datetime(2023, 1, 15, 10)


def test_date_columns_compare_as_midnight(spark):
    df = spark.sql("select explode(array(date'2023-01-01', date'2023-01-02', date'2023-01-03', null)) as d")
    assert expire.expired(df, "d", at("2023-01-02 00:00")).count() == 1
    assert expire.expired(df, "d", at("2023-01-02 10:00")).count() == 2
    assert expire.unexpired(df, "d", at("2023-01-02 10:00")).count() == 2
    with pytest.raises(TypeError):
        expire.expired(spark.range(1), "id", at("2023-01-02"))


def test_digest_notices_changes(spark):
    def value(rows):
        r = digest.content_totals(spark.createDataFrame(rows, "a string, b string")).first()
        return r["rows"], r["digest"]

    base = value([("x", None), ("y", "z")])
    assert value([("y", "z"), ("x", None)]) == base
    assert value([(None, "x"), ("y", "z")]) != base
    # A pair of equal rows does not cancel.
    assert value([("x", None), ("y", "z"), ("q", "q"), ("q", "q")])[1] != base[1]
    assert value([]) == (0, 0)


def test_digest_ignores_partitioning_and_column_order(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 3 as string) as s", "map('k', id) as m")
    want = digest.content_totals(df).first()
    assert digest.content_totals(df.repartition(7).select("m", "s", "id")).first() == want
    exact = df.select(digest.row_hash(df.schema).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("d"))
    assert exact.first()["d"] == want["digest"]
    groups = digest.grouped_totals(df, {"g": F.col("id") % 3}).agg(F.sum("rows"), F.sum("digest")).first()
    assert tuple(groups) == tuple(want)
