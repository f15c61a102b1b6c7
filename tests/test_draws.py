"""Posterior tables against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarea.operators import draws as dr

SCHEMA = "level string, variant string, param string, idx int, iter long, value double"


@pytest.fixture
def chains():
    rng = np.random.default_rng(9)
    return {"beta": rng.normal(1, 2, 600), "tau2": np.exp(rng.normal(size=400))}


@pytest.fixture
def draws(spark, chains):
    rows = [("SA2", "nc", p, 1, i, float(v)) for p, c in chains.items() for i, v in enumerate(c, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_thinning(draws):
    kept = sorted(r.iter for r in dr.thin_draws(draws.where("param = 'beta'"), 100, 100).collect())
    assert kept == [200, 300, 400, 500, 600]


def test_summary(draws, chains):
    got = {r.param: r for r in dr.posterior_summary(draws).collect()}
    for p, c in chains.items():
        r = got[p]
        assert r.n_draws == len(c)
        assert r.mean == pytest.approx(c.mean()) and r.sd == pytest.approx(c.std(ddof=1))
        assert r.naive_se == pytest.approx(c.std(ddof=1) / len(c) ** 0.5)
        assert [r[k] for k in dr.SUMMARY] == pytest.approx(list(np.quantile(c, list(dr.SUMMARY.values()))))


def test_single_draw(spark):
    df = spark.createDataFrame([("SA2", "nc", "beta", 1, 1, 2.0)], SCHEMA)
    r = dr.posterior_summary(df).first()
    assert r.sd is None and r.q50 == 2.0
    m = dr.mixing(df).first()
    assert m.n_batches == 1 and m.mcse is None and m.geweke_z is None


def test_mixing(draws, chains):
    got = {r.param: r for r in dr.mixing(draws, 20).collect()}
    for p, c in chains.items():
        means = c.reshape(20, -1).mean(1)
        mcse = means.std(ddof=1) / 20**0.5
        r = got[p]
        assert r.n_draws == len(c) and r.mcse == pytest.approx(mcse)
        assert r.ess == pytest.approx(c.var(ddof=1) / mcse**2)
        early, late = means[:2], means[10:]
        error = (early.var(ddof=1) / 2 + late.var(ddof=1) / 10) ** 0.5
        assert r.geweke_z == pytest.approx((early.mean() - late.mean()) / error)


def test_trace_is_ordered(draws, chains):
    got = [r.value for r in dr.trace(draws).where("param = 'tau2'").collect()]
    assert got == list(chains["tau2"])


def test_density(draws, chains):
    for p, c in chains.items():
        counts, ends = np.histogram(c, bins=16)
        got = {r.bin: r for r in dr.density_bins(draws, 16).where(F.col("param") == p).collect()}
        assert {b: r.n_draws for b, r in got.items()} == {i + 1: n for i, n in enumerate(counts) if n}
        width = ends[1] - ends[0]
        assert sum(r.density * width for r in got.values()) == pytest.approx(1.0)
        assert got[1].midpoint == pytest.approx(ends[0] + width / 2)


def test_density_of_constant_draws(spark):
    df = spark.createDataFrame([("SA2", "nc", "beta", 1, i, 2.0) for i in range(3)], SCHEMA)
    r = dr.density_bins(df, 4).collect()
    assert [(x.bin, x.n_draws, x.density) for x in r] == [(1, 3, None)]


@pytest.mark.parametrize("count", [0, 1, 5, 9, 10, 25, 400])
def test_log_factorial(spark, count):
    df = spark.createDataFrame([(float(count),)], "o double")
    got = df.select(dr.log_gamma_plus_one(F.col("o"))).first()[0]
    assert got == pytest.approx(math.lgamma(count + 1), abs=1e-9)


def test_fit_criteria(spark):
    rng = np.random.default_rng(4)
    observed = rng.poisson(8, 12).astype(float)
    observed[0] = 0.0
    observed[1] = 900.0
    mu = np.maximum(observed, 0.5)[:, None] * np.exp(rng.normal(0, 0.2, (12, 80)))
    # A hopeless area and a hopeless draw: their densities are far below exp(-745).
    observed[2] = 20_000.0
    mu[3, 7] = 9_000.0
    frame = spark.createDataFrame([(i, float(o)) for i, o in enumerate(observed)], "area int, observed double")
    fits = spark.createDataFrame(
        [(i, t, float(mu[i, t])) for i in range(12) for t in range(80)], "area int, iter int, fitted double"
    )
    lgam = np.array([math.lgamma(o + 1) for o in observed])
    ll = observed[:, None] * np.log(mu) - mu - lgam[:, None]
    dbar = -2 * ll.mean(1).sum()
    m = mu.mean(1)
    dhat = -2 * (observed * np.log(m) - m - lgam).sum()
    peak = ll.max(1)
    lppd = (peak + np.log(np.exp(ll - peak[:, None]).mean(1))).sum()
    p_waic = ll.var(1, ddof=1).sum()
    low = ll.min(1)
    lmpl = (low - np.log(np.exp(low[:, None] - ll).mean(1))).sum()
    r = dr.fit_criteria(fits, frame, "area").first()
    assert r.dic == pytest.approx(2 * dbar - dhat) and r.p_dic == pytest.approx(dbar - dhat)
    assert r.waic == pytest.approx(-2 * (lppd - p_waic)) and r.p_waic == pytest.approx(p_waic)
    assert r.lmpl == pytest.approx(lmpl)


# Published medians and intervals per level, one of them inconsistent.
INTERVALS = [
    ("Mesh", 0.26, 0.23, 0.28),
    ("SA1", 0.002, 0.001, 0.003),
    ("SA2", 0.0015, 0.008, 0.003),
    ("SA3", 0.004, 0.002, 0.009),
    ("SA4", 0.008, 0.002, 0.024),
]


def test_interval_table_flags_the_inconsistent_row(spark, rows):
    df = spark.createDataFrame(INTERVALS, "level string, Median_6 double, lower_6 double, upper_6 double")
    got = dr.interval_table(df, "level", {"sigma_u2": ("Median_6", "lower_6", "upper_6")})
    assert got.columns == ["level", "parameter", "median", "lower", "upper", "consistent"]
    assert [k for k, ok in rows(got, "level", "consistent") if not ok] == ["SA2"]


def test_fit_criteria_with_draws_of_zero(spark):
    """Certain where nothing was observed; impossible elsewhere, without losing the other models."""
    rng = np.random.default_rng(6)
    mu = rng.gamma(2.0, 1.0, (4, 50))
    mu[0, 3] = 0.0
    observed = np.array([0.0, 2.0, 1.0, 4.0])
    rows = [("a", i, t, float(mu[i, t])) for i in range(4) for t in range(50)]
    rows += [("b", i, t, 0.0 if (i, t) == (1, 5) else float(mu[i, t])) for i in range(4) for t in range(50)]
    fits = spark.createDataFrame(rows, "m string, area int, iter int, fitted double")
    frame = spark.createDataFrame([(m, i, float(o)) for m in "ab" for i, o in enumerate(observed)], "m string, area int, observed double")
    got = {r.m: r for r in dr.fit_criteria(fits, frame, "area", ["m"]).collect()}
    with np.errstate(divide="ignore", invalid="ignore"):
        ll = np.where(observed[:, None] == 0, -mu, observed[:, None] * np.log(mu) - mu)
    ll = ll - np.array([math.lgamma(o + 1) for o in observed])[:, None]
    p_waic = ll.var(1, ddof=1).sum()
    assert got["a"].p_waic == pytest.approx(p_waic)
    assert got["a"].waic == pytest.approx(-2 * (np.log(np.exp(ll).mean(1)).sum() - p_waic))
    assert got["b"].lmpl == -math.inf and got["b"].dic == math.inf and got["b"].p_waic == math.inf
