"""Every query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from firnline.plans import bindings
from helpers import bag

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(bindings.QUERIES) == set(bindings.ORACLES)
    assert set(bindings.QUERIES) <= set(contract.queries())
    assert set(bindings.ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF_DIR)
    duck.execute(bindings.ORACLES[name])
    names = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, duck.fetchall())
