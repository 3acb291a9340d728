"""Queries with SQL against another engine, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from daypanel.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    engine = duckdb.connect()
    for f in Path(SF_DIR).glob("*.parquet"):
        engine.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF_DIR)
    want = engine.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
