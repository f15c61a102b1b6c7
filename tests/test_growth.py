"""What grows with the data stays on the executors."""

import pytest
from pyspark.sql import functions as F

from tessarea.operators import autocorrelation as ac
from tessarea.operators import draws as dr
from tessarea.operators import smoothing as sm
from tessarea.session import scratch_path


def stored_range(spark, n, path):
    spark.range(n).select(F.col("id").alias("area"), (F.col("id") % 5).cast("double").alias("observed")).write.parquet(path)
    return spark.read.parquet(path)


def test_criteria_broadcast_neither_draws_nor_areas(spark):
    """Draws exploded from a small file are estimated by the size of that file."""
    frame = stored_range(spark, 500, scratch_path(spark, "test"))
    draws = frame.select("area", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("iter")).withColumn(
        "fitted", 1.0 + F.col("iter") % 3
    )
    state = dr.criteria_state(draws, frame, "area")
    assert state.agg(F.sum("n")).first()[0] == 25_000
    state.collect()
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_permutations_of_large_graphs_shuffle_no_area_per_permutation(spark):
    """What is shuffled is the graph, once per unit of work, not once per permutation."""
    n = 3_000
    values = spark.range(n).select(F.col("id").alias("area"), (F.col("id") % 7).cast("double").alias("x"))
    ends = values.select("area", F.explode(F.array(F.col("area") + 1, F.col("area") - 1)).alias("dst"))
    graph = ends.where(f"dst BETWEEN 0 AND {n - 1}").withColumnRenamed("area", "src")
    large, small = (ac.moran_mc(values, graph, 500, packed=packed) for packed in (0, ac.PACKED))
    assert tuple(large.first()) == pytest.approx(tuple(small.first()))
    z = ac._centred(values, [], "area", "x")
    crosses = ac._streamed_crosses(z, graph.where("src < dst"), [], 500, 1, ac.BLOCK, ac.BUCKET_BITS)
    rows = crosses.collect()
    assert len(rows) == 500
    sent = rows_sent(crosses)
    assert 0 < sent < 500 * n / 10


def rows_sent(df):
    """Rows that all exchanges of a finished query wrote."""
    node = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [node]
    while stack:
        plan = stack.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(plan.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return total


def test_missing_values_reach_no_permutation(spark):
    """A missing value is not taken for a number: a permutation that meets one does not count."""
    values = spark.range(30).select(F.col("id").alias("area"), F.expr("if(id = 4, NULL, CAST(id % 7 AS DOUBLE))").alias("x"))
    graph = spark.range(29).selectExpr("inline(array(struct(id AS src, id + 1 AS dst), struct(id + 1 AS src, id AS dst)))")
    assert ac.moran_mc(values, graph, 40).first().n_at_least == 0
    assert ac.moran_mc(values, graph, 40, packed=0).first().n_at_least <= 40


def test_products_exchange_only_the_values_at_borders(spark, monkeypatch):
    """Blocks of a line owe each other their ends, of a hub's neighbours one sum; one block gives the same fit."""
    n = 400
    frame = spark.range(n + 1).selectExpr("id AS area", "CAST(1 + id % 7 AS DOUBLE) AS observed", "3D AS expected")
    ends = [(a, a + 1) for a in range(n - 1)] + [(n, a) for a in range(0, n, 2)]
    edges = spark.createDataFrame(ends + [(b, a) for a, b in ends], "src long, dst long")
    counts, fits = [], []
    sent = sm.border_values

    def counted(*args):
        found = sent(*args)
        counts.append(found.selectExpr("sum(length(data)) / 8").first()[0])
        return found

    monkeypatch.setattr(sm, "border_values", counted)
    for rows in (50, n + 1):
        monkeypatch.setattr(sm, "ROWS_PER_BLOCK", rows)
        fit = sm.bym_map(frame, edges, 0.3, 0.05, max_steps=1, hot_degree=100)
        fits.append({r.area: (r.beta, r.phi, r.theta, r.fitted) for r in fit.areas.collect()})
        if rows == 50:
            # Two ends of eight or nine borders, sums for the hub, and the hub's value for every block.
            assert 0 < max(counts) <= 4 * (n // rows + 2)
            counts.clear()
    assert not any(counts)
    assert len(fits[0]) == n + 1
    for area, effects in fits[0].items():
        assert effects == pytest.approx(fits[1][area], rel=1e-9, abs=1e-9)


def test_smoothing_takes_repeated_and_missing_rows(spark):
    """A repeated edge or area counts each time; a row without a count changes no other area's sums."""
    rows = [(0, 3.0, 2.0), (1, 1.0, 2.0), (1, 2.0, 2.0), (2, None, 2.0), (3, 4.0, 2.0), (None, 2.0, 2.0)]
    frame = spark.createDataFrame(rows, "area long, observed double, expected double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    fit = sm.bym_map(frame, edges, 0.3, 0.05, max_steps=1)
    found = {(r.area, r.observed): (r.phi, r.theta) for r in fit.areas.collect()}
    assert set(found) == {(a, o) for a, o, _ in rows}
    assert found[2, None] == (None, None)
    assert all(None not in effects for key, effects in found.items() if key != (2, None))
