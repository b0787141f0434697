"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    expected = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
