"""The six-type canonical archive encoding and its inverse.

Canonical archives hold only int, bigint, float, double, boolean and string, with
dates and timestamps as RFC3339 text. Native archives keep Spark's own types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldkeep.functions.timestamps import parse_rfc3339, rfc3339

# Database type names (exact, lower case) and their canonical type.
# Any other name is stored as a string.
CANONICAL_BY_DB_TYPE = {
    "integer": "int32", "int": "int32", "int4": "int32",
    "smallint": "int32", "int2": "int32", "tinyint": "int32", "mediumint": "int32",
    "bigint": "int64", "int8": "int64", "serial": "int64", "bigserial": "int64",
    "real": "float32", "float4": "float32", "float": "float32",
    "double precision": "float64", "float8": "float64", "double": "float64",
    "boolean": "bool", "bool": "bool",
}

# Spark type and read-back database name of each canonical type.
SPARK_BY_CANONICAL = {
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
}
DB_TYPE_BY_CANONICAL = {
    "int32": "int4", "int64": "int8", "float32": "float4",
    "float64": "float8", "bool": "bool", "string": "text",
}

_CANONICAL_BY_SPARK = {
    T.ByteType: "int32", T.ShortType: "int32", T.IntegerType: "int32",
    T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
    T.BooleanType: "bool",
}
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)
# The default JSON formats would cut times inside nested values to milliseconds.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}


def canonical_of_db_type(name: str) -> str:
    return CANONICAL_BY_DB_TYPE.get(name, "string")


def canonical_of(data_type: T.DataType) -> str:
    return _CANONICAL_BY_SPARK.get(type(data_type), "string")


def _to_text(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, _TIME_TYPES):
        return rfc3339(column, data_type)
    if isinstance(data_type, _NESTED_TYPES):
        return F.to_json(column, _JSON)
    return column.cast("string")


def _from_text(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, _TIME_TYPES):
        return parse_rfc3339(column, data_type)
    if isinstance(data_type, _NESTED_TYPES):
        return F.from_json(column, data_type, _JSON)
    return column.cast(data_type)


def encode(df: DataFrame) -> DataFrame:
    """Every column in its canonical type; NULL stays NULL. One projection, no UDF."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = canonical_of(field.dataType)
        if kind == "string":
            out.append(_to_text(column, field.dataType).alias(field.name))
        else:
            out.append(column.cast(SPARK_BY_CANONICAL[kind]).alias(field.name))
    return df.select(*out)


def encode_as(df: DataFrame, db_types: dict[str, str]) -> DataFrame:
    """Encode by declared database type names instead of the Spark types.

    A declared column the DataFrame lacks becomes NULL. Casts raise on overflow.
    """
    out = []
    present = {f.name: f.dataType for f in df.schema.fields}
    for name, db_type in db_types.items():
        kind = canonical_of_db_type(db_type)
        target = SPARK_BY_CANONICAL[kind]
        if name not in present:
            out.append(F.lit(None).cast(target).alias(name))
        elif kind == "string":
            out.append(_to_text(F.col(f"`{name}`"), present[name]).alias(name))
        else:
            out.append(F.col(f"`{name}`").cast(target).alias(name))
    return df.select(*out)


def decode(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Back to the declared types, by column name.

    Only columns declared as dates or timestamps are parsed as such; text that
    happens to look like a time stays text.
    """
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            continue
        column = F.col(f"`{field.name}`")
        if canonical_of(field.dataType) == "string":
            out.append(_from_text(column, field.dataType).alias(field.name))
        else:
            out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)
