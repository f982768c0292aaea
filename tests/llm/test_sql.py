"""Training-data queries with SQL give the same rows as DuckDB on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

from polyglean.llm import queries as llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    df = llm.QUERIES[name](spark, str(DATA))
    if name not in llm.SQL:
        assert df.count() >= 1
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.sql(llm.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    places = [rel.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in places) for r in rel.fetchall())
