"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from pointframe import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


MAY_BE_EMPTY = {"agg4_planes"}  # too few points in a voxel at this size


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    got = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in got.collect())
    cur = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
