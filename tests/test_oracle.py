"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans import catalog
from tessera.session import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = E.oracle_sql()[name]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert srows == drows
