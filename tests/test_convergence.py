"""The registered smoothing fits are at the mode of the penalised likelihood."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry_module
from workload import models
from workload.oracle import complete

from .compare import connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_mesh_fit_meets_the_score_equations(spark, con):
    """The gradient vanishes: by theta in each area, by phi and by the intercept."""
    fit = {r.MB_CODE16: r for r in entry_module.queries()["bym_map"](spark, SF_DIR).collect()}
    edges = con.execute(complete(f"SELECT src, dst FROM ({models._ONE_EDGES}) e")).fetchall()
    laplace = dict.fromkeys(fit, 0.0)
    for src, dst in edges:
        laplace[src] += fit[src].phi - fit[dst].phi
    gap = np.array([r.observed - r.fitted for r in fit.values()])
    by_theta = gap - np.array([r.theta for r in fit.values()]) / models.SIGMA2
    by_phi = gap - np.array(list(laplace.values())) / models.TAU2
    # Effects are rounded to six places, so a penalty's gradient to their over the variance.
    assert abs(gap.sum()) < 1e-4
    assert np.abs(by_theta).max() < 2e-6 / models.SIGMA2
    assert np.abs(by_phi).max() < 2e-5 / models.TAU2
