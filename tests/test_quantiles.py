import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarea.operators import quantiles as q
from tessarea.operators.deprivation import quantile_cuts, quintile
from tessarea.operators.frame import row_slice
from tessarea.operators.summary import describe_measure, measure_range, measure_sd

PROBS = (0.0, 0.025, 0.2, 0.25, 0.5, 0.8, 0.975, 1.0)


@pytest.fixture
def small_brackets(monkeypatch):
    """Several passes also for a few hundred rows."""
    monkeypatch.setattr(q, "CELLS", 16)
    monkeypatch.setattr(q, "SMALL", 20)


def values_of(df, key=None):
    return {r[key] if key else None: r["values"] for r in df.collect()}


def test_against_numpy_whole_group(spark):
    data = [float(x) for x in np.random.default_rng(1).normal(size=37)]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    got = values_of(q.quantiles(df, "x", PROBS))[None]
    assert got == pytest.approx(list(np.quantile(data, PROBS)), abs=1e-12)


@pytest.mark.parametrize("kind", ["normal", "ties", "one_heavy_value", "heavy_tail", "extremes"])
def test_against_numpy_bracketed(spark, small_brackets, kind):
    rng = np.random.default_rng(7)
    data = {
        "normal": rng.normal(size=5000),
        "ties": rng.integers(0, 9, size=5000).astype(float),
        "one_heavy_value": np.where(rng.random(5000) < 0.5, 3.0, rng.normal(size=5000)),
        "heavy_tail": np.exp(rng.normal(size=5000) * 8),
        "extremes": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=500)]),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(6)
    got = values_of(q.quantiles(df, "x", PROBS))[None]
    assert got == pytest.approx(list(np.quantile(data, PROBS)), rel=1e-12, abs=1e-12)


def test_groups_of_unlike_size(spark, small_brackets):
    """One group holds nearly all rows, another a single one."""
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=4000), "small": rng.normal(size=7), "single": np.array([2.5])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    rows += [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = values_of(q.quantiles(df, "x", PROBS, ["k"]), "k")
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(v, PROBS)), abs=1e-12)


def test_no_rows(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert values_of(q.quantiles(df, "x", [0.5]))[None] is None
    cuts = quantile_cuts(df, "x")
    assert cuts.count() == 0


def test_scale_of_given_table(spark):
    """Past the limit for whole groups with the real settings."""
    df = spark.range(0, 250_000).select(((F.col("id") * 7919) % 250_000).cast("double").alias("x"))
    got = values_of(q.quantiles(df, "x", (0.2, 0.4, 0.5)))[None]
    assert got == pytest.approx([249_999 * p for p in (0.2, 0.4, 0.5)])


def test_quintile_cut_belongs_to_lower_class(spark, rows):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 12)], "k int, x double")
    got = dict(rows(quintile(df, "x", "c"), "k", "c"))
    # Cuts are 3, 5, 7 and 9.
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 9: 4, 10: 5, 11: 5}


def test_quintile_ties_and_missing(spark, rows):
    df = spark.createDataFrame(
        [(1, 5.0), (2, 5.0), (3, 5.0), (4, None), (5, float("nan"))], "k int, x double"
    )
    assert rows(quintile(df, "x", "c"), "k", "c") == [(1, 1), (2, 1), (3, 1), (4, None), (5, None)]


def test_quintile_by_group_keeps_groups_without_values(spark, rows):
    data = [("a", float(i)) for i in range(10)] + [("b", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = quintile(df, "x", "c", ["g"]).groupBy("g", "c").count()
    assert rows(got) == [("a", c, 2) for c in range(1, 6)] + [("b", None, 1)]


def test_describe(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, None, float("nan"))], "x double")
    d = describe_measure(df, "x").first()
    assert (d.minimum, d.q1, d.median, d.q3, d.maximum) == (1.0, 1.5, 2.0, 3.0, 4.0)
    assert d.mean == pytest.approx(7 / 3) and d.n_missing == 2
    assert tuple(measure_range(df, "x").first()) == (1.0, 4.0)


def test_sd_of_single_row_is_null(spark):
    assert measure_sd(spark.createDataFrame([(3.0,)], "x double"), "x").first().sd is None


@pytest.mark.parametrize("lo, hi, want", [(1, 3, [0, 1, 2]), (98, 250, [97, 98, 99]), (50, 50, [49]), (101, 105, [])])
def test_row_slice(spark, lo, hi, want):
    df = spark.range(100).select((F.col("id") * 10).alias("k")).repartition(7)
    assert sorted(r.k for r in row_slice(df, "k", lo, hi).collect()) == [10 * w for w in want]


def test_infinite_values(spark, small_brackets):
    df = spark.createDataFrame([(x,) for x in [float("-inf")] * 30 + [float(i) for i in range(41)] + [float("inf")] * 30], "x double")
    assert values_of(q.quantiles(df, "x", [0.0, 0.5, 1.0]))[None] == [float("-inf"), 20.0, float("inf")]


@pytest.mark.parametrize("kind", ["null", "text", "large"])
def test_row_slice_keys_of_any_kind(spark, kind):
    keys = {
        "null": [None, None, *range(40)],
        "text": [f"k{i:03}" for i in range(40)],
        "large": [2**53 + i for i in range(40)],
    }[kind]
    df = spark.createDataFrame([(k,) for k in keys], "k string" if kind == "text" else "k long").repartition(5)
    present = sorted(k for k in keys if k is not None)
    assert sorted(r.k for r in row_slice(df, "k", 7, 7).collect()) == present[6:7]
    assert sorted(r.k for r in row_slice(df, "k", 30, 90).collect()) == present[29:]


def test_describe_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    got = {r.g: r for r in describe_measure(df, "x", ["g"]).collect()}
    assert got["a"].median == 2.0 and got["a"].n_missing == 0 and got["b"].median is None and got["b"].n_missing == 1
    assert {r.g: r.hi for r in measure_range(df, "x", ["g"]).collect()} == {"a": 3.0, "b": None}


def test_row_slice_bracketed(spark, small_brackets):
    df = spark.range(3000).select((F.col("id") * 3).alias("k")).repartition(7)
    got = sorted(r.k for r in row_slice(df, "k", 1609, 2000).collect())
    assert got == [3 * i for i in range(1608, 2000)]
