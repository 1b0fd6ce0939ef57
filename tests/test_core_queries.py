import os

import duckdb
import pytest

from stepframe.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    a, b = (df[order].sort_values(order).reset_index(drop=True) for df in (got, want))
    assert a.equals(b)
