"""Every registered query of the engine against its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

from plumbline.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    session = duckdb.connect()
    session.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        session.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    yield session
    session.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    mine = counted(df.columns, df.collect())
    result = duck.execute(ORACLE_SQL[name])
    theirs = counted([c[0] for c in result.description], result.fetchall())
    assert mine == theirs
    assert mine[1], "a query that returns nothing proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
