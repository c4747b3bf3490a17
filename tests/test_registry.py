"""Every query with SQL agrees with it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", ["metro_trips", "taxi_trips", "od_variability", "gravity_by_station", "poi_radius_counts",
                                  "page_links", "tensor_percent", "mttkrp_mode1", "ntf_bpp"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    got = check.rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([c[0] for c in result.description], result.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "hour", "src", "dst", "cnt"] and df.count() > 0
