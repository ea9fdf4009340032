"""Every registered query at the smallest scale against its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # nothing multiplies whole tables, and Python never sees one row at a time
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    columns, rows = canonical([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        return
    cursor = db.execute(ORACLES[name])
    want_columns, want = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert columns == want_columns
    assert rows == want


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
