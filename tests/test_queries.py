"""Every registered query with SQL against DuckDB over the same tables."""

import decimal
import os

import duckdb
import pytest

from millrace.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for n in os.listdir(SF):
        con.sql(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = sorted((tuple(norm(v) for v in row) for row in duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()), key=repr)
        assert sorted(duck.sql(SQL[name]).columns) == columns
        assert got == want
