"""Every registered motion query that SQL can express, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from kinetra import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.SQL[name])
    columns, expected = rows([c[0] for c in want.description], want.fetchall())
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got_columns == columns
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["clip_id", "t", "data"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
