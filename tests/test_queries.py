"""Every query with SQL gives the same rows as DuckDB at the smallest scale; the others run and keep their schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from archive_catalog.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert df.columns and rows
        return
    got = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in got.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["kind", "group_id", "file_id", "n_members"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
