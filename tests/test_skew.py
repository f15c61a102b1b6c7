"""A third of all rows under one key: same results, and the key is split."""

import pytest
from pyspark.sql import functions as F

from tessarea.operators import concordance as cc
from tessarea.operators import draws as dr
from tessarea.operators import hierarchy as hi


@pytest.fixture
def small_joins(spark):
    """No broadcasts, and partitions small enough to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


@pytest.fixture
def members(spark):
    """Area 0 holds a third of 60,000 members."""
    return spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("mb"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("sa2"),
        (F.col("id") % 5).alias("pop"),
    )


def test_shares_of_a_hot_parent(spark, members, small_joins):
    shares = hi.population_share(members, "sa2", "pop", "total", "share")
    sums = {r.sa2: (r.share_sum, r.ok) for r in hi.share_check(shares, "sa2", "share").collect()}
    assert len(sums) == 98 and all(ok for _, ok in sums.values())
    shares.collect()
    final = shares._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final


def test_collapse_of_a_hot_stratum_is_partial_first(spark, members):
    collapsed = cc.collapse_strata(members, ["sa2"], {"pop": "pop"})
    plan = collapsed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")
    assert collapsed.count() == 98


def test_summary_of_a_hot_parameter(spark, members, small_joins):
    draws = members.select(
        F.lit("SA2").alias("level"), F.lit("nc").alias("variant"), F.lit("psi").alias("param"),
        F.col("sa2").alias("idx"), F.col("mb").alias("iter"), F.col("mb").cast("double").alias("value"),
    )
    got = {r.idx: r for r in dr.posterior_summary(draws).collect()}
    assert got[0].n_draws == 20_000
    assert got[0].q50 == pytest.approx(3 * (20_000 - 1) / 2)
    assert got[0].q025 == pytest.approx(3 * 0.025 * 19_999)
