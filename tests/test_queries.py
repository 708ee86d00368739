"""Every relational query against its SQL, run by DuckDB on the same tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tarnlake.plans import registry
from tests.conftest import SF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def plain(x):
    return float(x) if isinstance(x, Decimal) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())
