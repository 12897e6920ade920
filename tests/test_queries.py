"""Every query with SQL returns what DuckDB returns over the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from clausemine.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return tuple(0.0 if isinstance(v, float) and v == 0 else round(v, 8) if isinstance(v, float) and math.isfinite(v) else v for v in row)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert Counter(map(plain, df.select(*columns).collect())) == Counter(map(plain, want.project(", ".join(columns)).fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
