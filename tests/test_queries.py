"""Every query against its SQL, over the smallest tables."""

import decimal
import os

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET temp_directory = ''")
    c.execute("SET memory_limit = '4GB'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(map(plain, r)) for r in con.fetchall())
    assert sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
