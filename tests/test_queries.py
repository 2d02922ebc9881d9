"""Every registered query against its SQL counterpart on the smallest data."""

import os

import pytest

from compare import compare, connect

from streamatlas.plans.all_queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).collect()


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["ord", "line_no", "line"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
