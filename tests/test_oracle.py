"""Every query with SQL equals it, row by row, whatever the order."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as driver
from trialbook import queries as catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[k] for k in order)) for r in found), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
