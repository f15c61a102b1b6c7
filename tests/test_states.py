"""Mergeable states of chains, digests of releases, totals of all levels at once."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarea.operators import draws as dr
from tessarea.operators import hierarchy as hi
from tessarea.operators import maplayer as ml

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEYS = ["param"]
VALUES = st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.0, -1.0, 1e-300, None])), min_size=0, max_size=40)


def frame(spark, values):
    return spark.createDataFrame([("b", v) for v in values], "param string, value double")


@FEW
@given(a=VALUES, b=VALUES)
def test_merged_states_equal_one_run(spark, a, b):
    merged = dr.merge_summaries([dr.summary_state(frame(spark, x), KEYS) for x in (a, b)], KEYS)
    whole = dr.summary_of(dr.summary_state(frame(spark, a + b), KEYS), KEYS).collect()
    got = dr.summary_of(merged, KEYS).collect()
    values = sorted(v for v in a + b if v is not None)
    assert len(got) == len(whole) == (1 if values else 0)
    if not values:
        return
    assert got[0].n_draws == len(values)
    size = max(abs(v) for v in values)
    assert got[0].mean == pytest.approx(np.mean(values), rel=1e-9, abs=1e-12 * size)
    if len(values) > 1:
        assert got[0].sd == pytest.approx(np.std(values, ddof=1), rel=1e-6, abs=1e-7 * size)
    for name, p in dr.SUMMARY.items():
        exact = values[math.floor(p * (len(values) - 1))]
        assert got[0][name] == pytest.approx(exact, rel=1.001e-3, abs=0)
        assert got[0][name] == pytest.approx(whole[0][name], rel=1e-9, abs=1e-300)


def test_infinite_and_missing_draws_do_not_count(spark):
    state = dr.summary_state(frame(spark, [1.0, None, float("nan"), float("inf"), -float("inf")]), KEYS)
    assert [r.n_draws for r in dr.summary_of(state, KEYS).collect()] == [1]


def chain(spark, rows):
    return spark.createDataFrame(rows, "area int, iter int, fitted double")


def test_criteria_of_merged_states(spark):
    rng = np.random.default_rng(3)
    observed = {1: 0.0, 2: 3.0, 3: 4000.0}
    data = spark.createDataFrame(list(observed.items()), "area int, observed double")
    draws = [(k, i, float(v)) for k, o in observed.items() for i, v in enumerate(rng.gamma(o + 1, size=60))]
    # A poor chain: its log densities lie in other bands.
    draws += [(3, 60 + i, 100.0 + i) for i in range(5)] + [(1, 60, 900.0)]
    parts = [[d for d in draws if d[1] % 3 == k] for k in range(3)]
    states = [dr.criteria_state(chain(spark, part), data, "area") for part in parts]
    one_by_one = dr.merge_criteria([dr.merge_criteria(states[:2], "area"), states[2]], "area")
    want = dr.fit_criteria(chain(spark, draws), data, "area").first().asDict()
    for state in (one_by_one, dr.merge_criteria(states, "area")):
        assert dr.criteria_of(state, "area").first().asDict() == pytest.approx(want, rel=1e-9)


def test_an_impossible_draw_in_one_chain(spark):
    data = spark.createDataFrame([(1, 2.0)], "area int, observed double")
    states = [dr.criteria_state(chain(spark, [(1, i, v) for i, v in enumerate(vs)]), data, "area") for vs in ((1.0, 2.0), (0.0, 3.0))]
    got = dr.criteria_of(dr.merge_criteria(states, "area"), "area").first()
    assert got.dic == math.inf and got.waic == math.inf and got.lmpl == -math.inf


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.sampled_from(["x", "y", None])), max_size=14)


@FEW
@given(a=ROWS, b=ROWS)
def test_release_changes_and_audit(spark, a, b):
    one, other = (spark.createDataFrame(x, "k long, v string") for x in (a, b))

    def digests(columns):
        return [ml.release_digest(df, "k", columns, 4) for df in (one, other)]

    got = {r.k: r.change for r in ml.release_changes(one, other, *digests(["v"]), "k", ["v"], 4).collect()}
    left, right = ({k: Counter(v for q, v in x if q == k) for k, _ in x} for x in (a, b))
    want = {}
    for k in set(left) | set(right):
        if left.get(k) != right.get(k):
            want[k] = "added" if k not in left else "removed" if k not in right else "changed"
    assert got == want
    audit = ml.release_audit(one, other, *digests([]), "k", 4).first()
    assert tuple(audit) == tuple(ml.key_audit(one, other, "k").first())


def test_agreeing_buckets_are_not_shuffled(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 77, "w").otherwise(F.col("v")))
    digests = [ml.release_digest(df, "k", ["v"]) for df in (old, new)]
    wanted = ml._differing(*digests)
    assert wanted.count() == 1
    assert [tuple(r) for r in ml.release_changes(old, new, *digests, "k", ["v"]).collect()] == [(77, "changed")]


def test_level_totals_equal_single_queries_and_scan_once(spark, rows):
    cells = [(i, i // 2 if i != 5 else None, i // 4, float(i % 3), None if i == 2 else i) for i in range(12)]
    members = spark.createDataFrame(cells, "a long, b int, c long, x double, n long")
    levels = {"A": "a", "B": "b", "C": "c"}
    got = hi.level_totals(members, levels, ["x", "n"])
    want = []
    for name, key in levels.items():
        want += [(name, *r) for r in members.groupBy(F.col(key).cast("bigint")).agg(F.sum("x"), F.sum("n")).collect()]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Expand" in plan
