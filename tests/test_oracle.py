"""Every core query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from keytide.plans.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, rel = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(rel.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(rel.select(*(f'"{c}"' for c in cols)).fetchall(), key=key)


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
