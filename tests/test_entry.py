"""Every core query against its SQL, over the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from panelforge.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}"
    if isinstance(value, dt.datetime):
        return str(value.date()) if value.time() == dt.time() else str(value)
    return str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(comparable(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert table(rows, df.columns) == table(cursor.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["article_id", "cik", "trading_day", "company_name"]
