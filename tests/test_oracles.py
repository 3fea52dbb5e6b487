"""Every registered query with checking SQL agrees with it on the smallest tables."""

import pytest
from checktool import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
EMPTY = {"w20_early_stop_all_idle"}  # no run of the smallest tables idles that long
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, con, name):
    found = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert found == ("EMPTY" if name in EMPTY else "")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
