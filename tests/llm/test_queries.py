"""The queries for training data against their SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelforge.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        cursor = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert rows == sorted(str(tuple(r[i] for i in order)) for r in cursor.fetchall())
