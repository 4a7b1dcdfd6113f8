"""Every query that has SQL gives the SQL's rows."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as registry
from shutterlake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_are_the_sql_rows(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(a) == len(b)
    loose = lambda rows: [tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows]
    assert loose(a) == loose(b)


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_sql_is_for_known_queries_only():
    assert set(registry.oracle_sql()) <= set(registry.queries())
