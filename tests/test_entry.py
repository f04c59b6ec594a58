import glob
import os

import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 6, 7)} <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["host_visualization", "systems", "p1_found", "p2_found", "p3_found", "p6_found", "p7_found"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as from read_parquet('{path}')")
    df = contract.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert mine == sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({contract.oracle_sql()[name]})").fetchall()))
