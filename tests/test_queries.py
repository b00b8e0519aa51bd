"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import lodegrid.record_queries  # noqa: F401  registers its queries
from lodegrid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda rs: sorted(repr([plain(r[c]) for c in columns]) for r in rs)
    assert key(rows) == key(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 625
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
