"""Every query with SQL gives DuckDB's rows over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    names = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == names
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in names)) for r in want.fetchall())


def test_entry(spark, small):
    assert catalog.entry(spark, small).count() > 0


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SQL])
def test_rows_only(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 1
