"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import database, differences
from workload import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert sorted(SQL) == sorted(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = contract.queries()[key](spark, FOLDER)
    assert differences(df, con, SQL[key]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
