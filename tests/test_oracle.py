"""Every catalog query against its SQL on an independent engine, at the
smallest scale; the larger scales are checked by the driver."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from daypanel.plans.catalog import QUERIES
from daypanel.plans.oracle import ORACLE

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ("", "")
        return (type(v).__name__, repr(v))

    return sorted([cell(r[i]) for i in order] for r in rows)


def test_both_sides_name_the_same_queries():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def no_pairs_and_no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, SF_DIR)
    no_pairs_and_no_python(df)
    cursor = engine.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(names, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
