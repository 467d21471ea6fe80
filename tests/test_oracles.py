"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {n: q for part in entry._CORE for n, q in part.QUERIES.items()}
SQL = {n: q for part in entry._CORE for n, q in part.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{round(x, 6) + 0.0:.6f}"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, DIR)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.collect(), df.columns) == table(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(CORE.keys() - SQL.keys()))
def test_other_queries_run(spark, name):
    assert CORE[name](spark, DIR).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
