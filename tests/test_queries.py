"""Every registered query against its SQL twin, on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry_module

from .compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = entry_module.REGISTRY
QUERIES = {name: q for name, q in entry_module.queries().items() if name in REGISTRY}
ORACLE = entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) & set(REGISTRY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["SA2_MAIN16", "observed", "expected", "SA2_NAME16", "sir"]
    assert df.count() == 25
