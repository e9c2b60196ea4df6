"""Every query with SQL beside it gives the rows that DuckDB gives; the others run and keep their schema."""

import math

import duckdb
import pandas as pd
import pytest

from tabulark.plans import FAMILIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: f for fam in FAMILIES for n, f in fam.QUERIES.items()}
ORACLES = {n: q for fam in FAMILIES for n, q in fam.ORACLES.items()}


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
