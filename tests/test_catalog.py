"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from cairn import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame, columns):
    out = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).replace({r"\.0$": ""}, regex=True)
    return sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 8
    assert set(e.oracle_sql()) <= set(e.queries())
