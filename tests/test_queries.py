"""Every base query against its SQL."""

import math

import duckdb
import pytest

from quillwork.plans import queries as base


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if type(v).__name__ in ("float", "Decimal"):
        return round(float(v), 6) + 0.0
    return str(list(v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in base.QUERIES if n in base.SQL])
def test_query(spark, db, data, name):
    df = base.QUERIES[name](spark, data)
    want = db.sql(base.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rows = sorted((tuple(plain(r[want.columns.index(c)]) for c in names) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.parametrize("name", [n for n in base.QUERIES if n not in base.SQL])
def test_runs(spark, data, name):
    assert base.QUERIES[name](spark, data).count() > 0


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(base.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
