"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarryline.plans import registry as catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}/*.parquet" if os.path.isdir(f"{DATA}/{t}") else f"{DATA}/{t}"
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    names = rel.columns
    expected = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in rel.fetchall())
    assert sorted(names) == columns
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
