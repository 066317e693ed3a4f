"""Every query with a SQL counterpart gives its rows."""

import os
from decimal import Decimal

import duckdb
import pytest

from threadloom.plans import registry


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    own = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    other = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in want.fetchall())
    assert own == other


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
