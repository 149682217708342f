"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    made = duckdb.connect()
    for f in os.listdir(SF):
        made.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return made


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    rows = catalog.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in rows.collect())
    done = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in done.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted({*catalog.queries()} - {*catalog.oracle_sql()}))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["iff_lineitem"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    assert "l_orderkey" not in plan
