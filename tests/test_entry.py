"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "caption", "distance", "mean_similarity"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, db, name):
    df, sql = entry.queries()[name](spark, FOLDER), db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    at = [sql.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=key)
    assert ours == theirs
