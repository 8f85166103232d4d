"""Every registered query that has SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

from changeloom.plans import catalog, delivery, structure  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list):
        return [plain(x) for x in value]
    return str(value) if value.__class__.__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]}) AS q").fetchall()
    assert sorted(str([plain(x) for x in r]) for r in frame.select(*columns).collect()) == sorted(str([plain(x) for x in r]) for r in want)


def test_queries_without_sql_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, DATA).count() > 0
