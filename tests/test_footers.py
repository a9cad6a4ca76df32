"""The dry run from Parquet footers: equal to a scan, and reading little."""

from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from coldkeep import TableRule
from coldkeep.operators.expire import expired
from coldkeep.operators.footers import expired_by_footers
from coldkeep.plans import archive
from coldkeep.sources.hot_table import HotTable
from tests.conftest import AS_OF, rule

BEGIN = datetime(2023, 1, 1)
DAYS = [BEGIN + timedelta(hours=6 * i) for i in range(1000)]
KINDS = {
    "ntz": (pa.timestamp("us"), T.TimestampNTZType(), DAYS),
    "millis": (pa.timestamp("ms"), T.TimestampNTZType(), DAYS),
    "utc": (pa.timestamp("us", "UTC"), T.TimestampType(), [d.replace(tzinfo=timezone.utc) for d in DAYS]),
    "date": (pa.date32(), T.DateType(), [d.date() for d in DAYS]),
}


def write(path, values, kind, group=50, **options):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"id": pa.array(range(len(values)), pa.int64()), "at": pa.array(values, kind)}), path, row_group_size=group, **options)


def count(spark, paths, cutoff, data_type):
    return tuple(expired_by_footers(spark, [f"file:{p}" for p in paths], "at", cutoff, data_type).first())


def scanned(spark, paths, cutoff, data_type):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", data_type)])
    return expired(spark.read.schema(schema).parquet(*[f"file:{p}" for p in paths]), "at", cutoff).count()


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cutoff", [DAYS[0], DAYS[437], DAYS[437] + timedelta(seconds=1), DAYS[500], DAYS[-1] + timedelta(days=2)])
def test_only_the_straddling_group_is_read(spark, tmp_path, kind, cutoff):
    arrow, data_type, values = KINDS[kind]
    write(tmp_path / "t" / "a.parquet", values, arrow)
    rows, groups, read = count(spark, [tmp_path / "t"], cutoff, data_type)
    assert (rows, groups) == (scanned(spark, [tmp_path / "t"], cutoff, data_type), 20)
    assert read <= 1


def test_files_of_every_sort(spark, tmp_path):
    """NULL dates, groups without facts, unsorted groups, INT96, files without the column, hidden and empty files, folders in folders."""
    root, (arrow, data_type, _) = tmp_path / "t", KINDS["ntz"]
    write(root / "x=a" / "nulls.parquet", [None if i % 3 == 0 else d for i, d in enumerate(DAYS)], arrow)
    write(root / "x=a" / "all_null.parquet", [None] * 100, arrow)
    write(root / "x=b" / "no_facts.parquet", DAYS, arrow, write_statistics=False)
    write(root / "x=b" / "mixed.parquet", DAYS[::2] + DAYS[1::2], arrow, group=600)
    write(root / "x=b" / "none.parquet", [], arrow)
    write(root / "_hidden" / "x.parquet", DAYS, arrow)
    write(root / "x=a" / ".y.parquet", DAYS, arrow)
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int64())}), root / "x=a" / "other.parquet")
    rows, groups, read = count(spark, [root], DAYS[437], data_type)
    assert rows == scanned(spark, [root], DAYS[437], data_type) > 437
    # of those with facts one straddling group each, two of the mixed file, and all without facts
    assert (groups, read) == (20 + 2 + 20 + 2 + 1 + 1, 1 + 20 + 2)
    write(tmp_path / "old.parquet", DAYS, pa.timestamp("ns"), use_deprecated_int96_timestamps=True)
    assert count(spark, [tmp_path / "old.parquet"], DAYS[437], data_type)[0] == 437
    assert count(spark, [], DAYS[437], data_type) == (0, 0, 0)
    with pytest.raises(TypeError):
        count(spark, [root], DAYS[437], T.StringType())


def test_a_damaged_file_is_an_error(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no footer")
    with pytest.raises(Exception):
        count(spark, [tmp_path / "bad.parquet"], DAYS[1], T.TimestampNTZType())


@pytest.mark.parametrize("unit", [None, "day"])
def test_preview_of_a_hot_table(spark, world, unit):
    table = TableRule("t", "at", 5, ("id",))
    rows = spark.createDataFrame([(i, AS_OF + timedelta(days=i % 40 - 20, minutes=i)) for i in range(400)] + [(900, None)], "id long, at timestamp_ntz")
    hot = HotTable.load(spark, f"{world.root}/hot", rows, "at", unit, ("id",))
    shown = archive.preview_rules([rule(table)], {"t": hot}, AS_OF).first()
    assert shown["expired_rows"] == expired(rows, "at", table.cutoff(AS_OF)).count() > 100
    hot.replace(list(hot.snapshot().parts))
    assert archive.preview_rules([rule(table)], {"t": hot}, AS_OF).first()["expired_rows"] == 0
