"""Every registered query against its DuckDB oracle on the smallest driver tables
(the same gate the driver applies at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tabsight.catalog import DRIVER_TABLES
from tabsight.suite.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["location", "sales_sum", "sales_mean", "sales_count"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert compare(df.columns, srows, dcols, cur.fetchall()) == []
