"""Rate models and smoothing against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarea.operators import model as mo
from tessarea.session import scratch_path

FRAME = "area long, observed double, expected double, quintile int"


@pytest.fixture
def grid():
    """Counts on a 5 x 6 grid with rook edges and five classes."""
    rng = np.random.default_rng(2)
    cells = [(r, c) for r in range(5) for c in range(6)]
    frame = []
    for r, c in cells:
        e = float(rng.uniform(0.5, 20))
        frame.append((10 * r + c, float(rng.poisson(e * np.exp(0.2 * c - 0.4))), e, 1 + (r + c) % 5))
    edges = [
        (10 * r + c, 10 * s + d)
        for r, c in cells
        for s, d in cells
        if abs(r - s) + abs(c - d) == 1
    ]
    return frame, edges


def dense_mode(frame, edges, tau2, sigma2, with_classes):
    """The mode by full Newton steps on the dense system of all effects."""
    keys = [f[0] for f in frame]
    at = {k: i for i, k in enumerate(keys)}
    size = len(keys)
    o, e = np.array([f[1] for f in frame]), np.array([f[2] for f in frame])
    classes = sorted({f[3] for f in frame}) if with_classes else [0]
    member = np.array([[(f[3] if with_classes else 0) == c for c in classes] for f in frame], float)
    laplace = np.zeros((size, size))
    for a, b in edges:
        laplace[at[a], at[a]] += 1
        laplace[at[a], at[b]] -= 1
    design = np.hstack([member, np.eye(size), np.eye(size)])
    k = len(classes)
    penalty = np.zeros((design.shape[1],) * 2)
    penalty[k : k + size, k : k + size] = laplace / tau2
    penalty[k + size :, k + size :] = np.eye(size) / sigma2
    effects = np.zeros(design.shape[1])
    effects[:k] = np.log(member.T @ o / (member.T @ e))
    for _ in range(50):
        mu = e * np.exp(design @ effects)
        gradient = design.T @ (o - mu) - penalty @ effects
        effects += np.linalg.lstsq(design.T * mu @ design + penalty, gradient, rcond=None)[0]
    beta, phi, theta = member @ effects[:k], effects[k : k + size], effects[k + size :]
    beta, phi = beta + phi.mean(), phi - phi.mean()
    eta = np.log(e) + beta + phi + theta
    objective = (o * eta - np.exp(eta)).sum() - phi @ laplace @ phi / (2 * tau2) - theta @ theta / (2 * sigma2)
    return {k: (beta[i], phi[i], theta[i], np.exp(eta[i])) for k, i in at.items()}, objective


@pytest.mark.parametrize("with_classes", [False, True])
@pytest.mark.parametrize("hot_degree", [4096, 1])
def test_smoothing_against_numpy(spark, grid, with_classes, hot_degree):
    """The same mode, also when every area counts as one of very many neighbours."""
    frame, edges = grid
    fit = mo.bym_map(
        spark.createDataFrame(frame, FRAME),
        spark.createDataFrame(edges, "src long, dst long"),
        0.3,
        0.05,
        covariate="quintile" if with_classes else None,
        hot_degree=hot_degree,
    )
    want, objective = dense_mode(frame, edges, 0.3, 0.05, with_classes)
    got = {r.area: (r.beta, r.phi, r.theta, r.fitted) for r in fit.areas.collect()}
    assert fit.settled and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6)
    trace = fit.trace.orderBy("step").collect()
    assert [r.step for r in trace] == list(range(len(trace)))
    assert trace[-1].gradient < 1e-6 and trace[-1].products == fit.rounds
    assert trace[-1].objective == pytest.approx(objective, abs=1e-6)
    assert all(b.objective >= a.objective - 1e-9 for a, b in zip(trace, trace[1:]))


def test_smoothing_stops_at_tolerance_and_guard(spark, grid):
    frame, edges = grid
    args = (spark.createDataFrame(frame, FRAME), spark.createDataFrame(edges, "src long, dst long"), 0.3, 0.05)
    early = mo.bym_map(*args, tol=1e6)
    assert early.settled and early.rounds == 1 and early.areas.count() == len(frame)
    ended = mo.bym_map(*args, max_steps=1)
    assert not ended.settled and ended.trace.count() == 2 and ended.areas.count() == len(frame)


def test_smoothing_of_a_class_without_cases_and_a_large_step(spark, grid):
    """Neither an impossible class nor a count far above expectation breaks the steps."""
    frame, edges = grid
    odd = [(k, 0.0 if q == 3 else (4000.0 if k == 11 else o), 0.001 if k == 11 else e, q) for k, o, e, q in frame]
    fit = mo.bym_map(
        spark.createDataFrame(odd, FRAME), spark.createDataFrame(edges, "src long, dst long"), 5.0, 4.0, covariate="quintile"
    )
    trace = fit.trace.orderBy("step").collect()
    assert fit.settled and trace[-1].gradient < 1e-6
    assert all(b.objective >= a.objective - 1e-9 for a, b in zip(trace, trace[1:]))
    assert sum(r.fitted for r in fit.areas.where("quintile = '3'").collect()) < 1e-5


def test_bucketed_edges_are_joined_without_shuffle(spark, grid):
    """Only the messages are exchanged, not the edges."""
    frame, edges = grid
    graph = spark.createDataFrame([(a, b, 0) for a, b in edges], "src long, dst long, slot int")
    copy, table = mo.bucketed_copy(graph, ["dst", "slot"], scratch_path(spark, "test"), 4)
    sent = spark.createDataFrame([(f[0], 0, f[2]) for f in frame], "dst long, slot int, phi double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = copy.join(sent, ["dst", "slot"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == len(edges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_two_models_in_one_job(spark, grid):
    """Variants of one level do not disturb each other."""
    frame, edges = grid
    both = [("SA1", v, *f[:3], f[3] if v == "wc" else None) for v in ("nc", "wc") for f in frame]
    frames = spark.createDataFrame(both, "level string, variant string, " + FRAME)
    graph = spark.createDataFrame(
        [("SA1", v, a, b) for v in ("nc", "wc") for a, b in edges],
        "level string, variant string, src long, dst long",
    )
    variances = spark.createDataFrame(
        [("SA1", "nc", 0.3, 0.05), ("SA1", "wc", 0.1, 0.02)],
        "level string, variant string, tau2 double, sigma2 double",
    )
    fit = mo.fit_all(frames, graph, variances)
    ends = {r.variant: r.products for r in fit.trace.groupBy("variant").agg(F.max("products").alias("products")).collect()}
    assert max(ends.values()) == fit.rounds and min(ends.values()) < fit.rounds  # the settled one leaves
    for variant, tau2, sigma2 in (("nc", 0.3, 0.05), ("wc", 0.1, 0.02)):
        want, _ = dense_mode(frame, edges, tau2, sigma2, variant == "wc")
        got = fit.areas.where(F.col("variant") == variant).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.beta, r.phi, r.theta, r.fitted) == pytest.approx(want[r.area], abs=1e-6)


def test_closed_form_equals_glm(spark, grid):
    frame, _ = grid
    df = spark.createDataFrame(frame, FRAME)
    exact = {r.term: r.estimate for r in mo.poisson_rates(df, "quintile").collect()}
    glm = {r.term: r.estimate for r in mo.poisson_glm(df, ["quintile"]).collect()}
    assert set(exact) == {"(Intercept)", *(f"quintile{q}" for q in (2, 3, 4, 5))}
    for term in exact:
        assert glm[term] == pytest.approx(exact[term], abs=1e-7)
    o, e = sum(f[1] for f in frame), sum(f[2] for f in frame)
    assert mo.poisson_rates(df).first().estimate == pytest.approx(np.log(o / e))


def test_rates_per_model(spark):
    data = [("a", 1, 4.0, 2.0), ("a", 2, 3.0, 3.0), ("b", 2, 0.0, 1.0), ("b", 3, 2.0, 1.0), ("b", None, 9.0, 1.0)]
    df = spark.createDataFrame(data, "m string, quintile int, observed double, expected double")
    got = {(r.m, r.term): r.estimate for r in mo.poisson_rates(df, "quintile", ["m"]).collect()}
    assert got[("a", "(Intercept)")] == pytest.approx(np.log(2))
    assert got[("a", "quintile2")] == pytest.approx(-np.log(2))
    # A level without cases has no finite estimate, nor has a contrast to it.
    assert got[("b", "(Intercept)")] is None and got[("b", "quintile3")] is None
    assert len(got) == 4


def test_fit_tables(spark, rows):
    fit = spark.createDataFrame(
        [(1, 4.0, 2.0, 4.0), (2, 1.0, 0.0, 4.0), (3, 0.0, 1.0, 0.0)],
        "area long, observed double, expected double, fitted double",
    )
    assert rows(mo.fitted_sir(fit), "area", "fitted_sir") == [(1, 2.0), (2, None), (3, 0.0)]
    assert rows(mo.residual_table(fit, "response"), "residual") == [(-3.0,), (0.0,), (0.0,)]
    assert rows(mo.residual_table(fit), "area", "residual") == [(1, 0.0), (2, -1.5), (3, None)]
    with pytest.raises(ValueError):
        mo.residual_table(fit, "deviance")
    assert rows(mo.observed_fitted(fit, fit, "area")) == [(1, 4.0, 4.0), (2, 1.0, 4.0), (3, 0.0, 0.0)]


def test_fallback_keeps_every_area(spark, rows):
    stats = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None)], "area long, sir double")
    fit = spark.createDataFrame([(1, 0.9), (2, float("nan"))], "area long, f double")
    out = mo.sir_with_fallback(stats, fit, "area", "sir", "f", "shown")
    assert rows(out, "area", "shown") == [(1, 0.9), (2, 0.7), (3, None)]


def test_glm_takes_the_lowest_of_many_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), float(rng.poisson(5) + 1), 2.0) for q in range(2, 13) for _ in range(20)]
    df = spark.createDataFrame(rows, "quintile int, observed double, expected double")
    exact = {r.term: r.estimate for r in mo.poisson_rates(df, "quintile").collect()}
    glm = {r.term: r.estimate for r in mo.poisson_glm(df, ["quintile"]).collect()}
    assert set(glm) == set(exact) and "quintile2" not in glm
    assert all(glm[t] == pytest.approx(exact[t], abs=1e-6) for t in exact)



def test_smoothing_leaves_out_edges_to_absent_areas(spark, grid):
    frame, edges = grid
    more = edges + [(frame[0][0], 999), (999, frame[0][0])]
    df = spark.createDataFrame(frame, FRAME)
    fits = [mo.bym_map(df, spark.createDataFrame(e, "src long, dst long"), 0.3, 0.05) for e in (edges, more)]
    a, b = ({r.area: r.fitted for r in f.areas.collect()} for f in fits)
    assert a == pytest.approx(b)


def test_general_design_against_newton_steps(spark):
    rng = np.random.default_rng(11)
    n = 400
    x, z = rng.normal(size=n), rng.uniform(0.5, 2, n)
    f, g = rng.integers(9, 12, n), rng.choice(["a", "b"], n)
    e = rng.uniform(1, 20, n)
    o = rng.poisson(e * np.exp(0.2 * x - 0.3 * (f == 10) + 0.4 * (f == 11) * x + 0.1 * (g == "b") * (f == 10)))
    rows = [tuple(map(float, r[:4])) + (int(r[4]), str(r[5])) for r in zip(o, e, x, z, f, g)]
    rows += [(5.0, 1.0, None, 1.0, 9, "a"), (5.0, 1.0, 1.0, float("nan"), 9, "a"), (5.0, 1.0, 1.0, 1.0, None, "a")]
    df = spark.createDataFrame(rows, "observed double, expected double, x double, z double, f int, g string")
    got = {r.term: r.estimate for r in mo.poisson_design(df, ["f", "g"], ["x", "z"], [("f", "x"), ("f", "g"), ("x", "z")]).collect()}
    columns = {"(Intercept)": np.ones(n), "x": x, "z": z, "gb": g == "b", "x:z": x * z}
    for q in (10, 11):
        columns |= {f"f{q}": f == q, f"f{q}:x": (f == q) * x, f"f{q}:gb": (f == q) & (g == "b")}
    design = np.column_stack([np.asarray(c, float) for c in columns.values()])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        mu = e * np.exp(design @ beta)
        beta += np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (o - mu))
    assert got == pytest.approx(dict(zip(columns, beta)), abs=1e-6)


def test_general_design_bounds_and_edges(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 7), 1) for i in range(1, 30)], "observed double, expected double, x double, one int")
    # A factor of one level has no term, and neither has its interaction.
    terms = {r.term for r in mo.poisson_design(df, ["one"], ["x"], [("one", "x")]).collect()}
    assert terms == {"(Intercept)", "x"}
    monkeypatch.setattr(mo, "MOST_COLUMNS", 5)
    for fit in (lambda: mo.poisson_design(df, ["x"]), lambda: mo.poisson_glm(df, ["x"])):
        with pytest.raises(ValueError, match="levels"):
            fit()
    with pytest.raises(ValueError, match="no covariates"):
        mo.poisson_design(df, [], ["x"], [("x", "y")])
