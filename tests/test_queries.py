"""Every query with SQL against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from kinfold import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, db, name):
    frame = queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    made = db.sql(queries.oracle_sql()[name])
    assert sorted(made.columns) == columns
    at = [made.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in made.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"load_decisions"}))
def test_others_give_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
