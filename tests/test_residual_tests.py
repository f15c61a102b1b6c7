"""Permutation tests on the residuals of all smoothed fits."""

import os

import pytest

import __spark_entry__ as entry_module
from tessarea.plans.levels import run_study
from workload import spatial
from workload.oracle import complete
from workload.registry import rounded
from workload.tables import Tables

from .compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_residual_tests_take_the_full_count(spark):
    assert "residual_moran_all" in entry_module.queries()
    row = entry_module.queries()["residual_moran"](spark, SF_DIR).first()
    assert row.nsim == 10_000
    assert row.p_value == pytest.approx((row.n_at_least + 1) / 10_001, abs=1e-6)


def test_all_ten_fits_against_sql(spark):
    """Query and twin with a loose tolerance, so that the fits end at their start."""
    study = run_study(Tables(spark, SF_DIR), tol=1e9)
    found = rounded(study.residual_moran_all())
    sql = complete(spatial.residual_moran_all_sql(tol=1e9))
    assert differences(found, connect(SF_DIR), sql) is None
    assert found.count() == 10
