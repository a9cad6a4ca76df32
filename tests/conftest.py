import os
import sys
import uuid
from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from coldkeep import Rule, TableRule  # noqa: E402
from coldkeep.session import prepare  # noqa: E402
from coldkeep.sources.archive_store import ArchiveStore  # noqa: E402
from coldkeep.sources.history import History  # noqa: E402
from coldkeep.sources.hot_table import HotTable  # noqa: E402

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file:{tmp_path_factory.mktemp('checkpoint')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


def at(text):
    return datetime.fromisoformat(text)


def ntz(name):
    return T.StructField(name, T.TimestampNTZType())


ORDERS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("customer", T.StringType()),
    T.StructField("amount", T.DecimalType(10, 2)), T.StructField("notes", T.StringType()),
    T.StructField("shipped", T.BooleanType()), ntz("created_at"),
])
ITEMS_SCHEMA = T.StructType([
    T.StructField("order_id", T.IntegerType()), T.StructField("item_id", T.IntegerType()),
    T.StructField("product", T.StringType()), T.StructField("quantity", T.IntegerType()), ntz("created_at"),
])
SENSOR_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()), T.StructField("sensor_id", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("humidity", T.DoubleType()),
    T.StructField("location", T.StringType()),
])


def small_orders(spark):
    from decimal import Decimal as D

    return spark.createDataFrame([
        (1, "a", D("10.50"), "first", True, at("2023-01-15 10:00")),
        (2, "b", None, None, False, at("2023-02-20 11:30")),
        (3, "c", D("7.25"), "third", True, at("2023-03-10 09:15")),
        (4, "d", D("99.99"), None, True, at("2023-04-05 14:00")),
        (5, "e", D("0.00"), "free", False, at("2023-05-25 16:45")),
        (6, "f", D("1.00"), "new", True, at("2023-12-31 00:00")),
        (7, "g", D("2.00"), None, False, at("2023-12-30 00:00:00.123456")),
        (8, "h", D("3.00"), "new", True, at("2023-12-27 00:00")),
    ], ORDERS_SCHEMA)


def small_items(spark):
    old = [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)]
    new = [(6, 1), (7, 1), (8, 1)]
    rows = [(o, i, f"p{o}{i}", i, at("2023-03-01 12:00")) for o, i in old]
    rows += [(o, i, f"p{o}{i}", i, at("2023-12-29 12:00")) for o, i in new]
    return spark.createDataFrame(rows, ITEMS_SCHEMA)


def small_sensors(spark):
    from datetime import timezone

    def utc(text):
        return at(text).replace(tzinfo=timezone.utc)

    old = ["2023-01-10", "2023-01-20", "2023-02-10", "2023-03-10", "2023-03-11", "2023-04-10", "2023-05-10"]
    new = ["2023-12-29", "2023-12-30", "2023-12-31"]
    rows = [(utc(f"{d} 06:00"), n, None if n == 2 else 20.5 + n, 40.0, "lab") for n, d in enumerate(old + new)]
    return spark.createDataFrame(rows, SENSOR_SCHEMA)


ORDERS_RULE = TableRule("orders", "created_at", 30, ("id",))
ITEMS_RULE = TableRule("order_items", "created_at", 30, ("order_id", "item_id"))
SENSOR_RULE = TableRule("sensor_data", "time", 30, ("time", "sensor_id"))


class World:
    """An archive store, a history and hot tables in a folder of their own."""

    def __init__(self, spark, root):
        self.spark = spark
        self.root = f"file:{root}/{uuid.uuid4().hex}"
        self.store = ArchiveStore(spark, f"{self.root}/archive")
        self.history = History(spark, f"{self.root}/history")

    def load(self, df, table, unit=None, name=None):
        where = f"{self.root}/hot/{name or table.name}"
        return HotTable.load(self.spark, where, df, table.date_column, unit, table.key)

    def local(self, path):
        return path.removeprefix("file:")


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def rule(*tables, **options):
    return Rule("r", "testdb", tables, **{"batch_size": 100, **options})


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
