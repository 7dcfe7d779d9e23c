"""Every query of the catalog against its SQL on the smallest tables, and its plan."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, rows_of
from weir.catalog.all import ORACLES as SQL
from weir.catalog.all import QUERIES

from .conftest import SMALL

# Cross joins and Python in the plan.
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BAD_NODES if b in plan]
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
