"""Every query that SQL can express, held against DuckDB over the smallest tables."""

import os

import __spark_entry__
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(result.description)}
    assert sorted(at) == names
    assert got == sorted((tuple(plain(r[at[n]]) for n in names) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.isdir(SF)
