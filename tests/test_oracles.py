"""Every registered query against its SQL, on all rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from coldkeep.oracles import ORACLES
from coldkeep.queries import QUERIES
from tests.conftest import SF

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    missing = frame.isna()
    frame = frame.astype(object).mask(missing, "")
    return sorted(tuple(str(v) for v in row) for row in frame.itertuples(index=False))


def test_every_query_has_an_oracle():
    assert sorted(ORACLES) == NAMES
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
