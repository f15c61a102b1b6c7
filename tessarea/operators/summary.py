"""Descriptions of a measure, one row or one per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_missing, is_missing
from ..session import cut_lineage
from .quantiles import quantiles


def describe_measure(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., minimum, q1, median, mean, q3, maximum, n_missing`` of a measure."""
    by = list(by)
    x = F.col("_v")
    extra = (F.min(x).alias("minimum"), F.avg(x).alias("mean"), F.max(x).alias("maximum"))
    cuts = quantiles(df, value, (0.25, 0.5, 0.75), by, extra)
    missing = df.groupBy(*by).agg(F.count_if(is_missing(F.col(value).cast("double"))).alias("n_missing"))
    if by:
        # A group without any value still has a row.
        joined = cut_lineage(missing, "missing").join(cuts, by, "left")
    else:
        joined = cuts.withColumn("n_missing", missing.scalar())
    return joined.select(
        *by,
        "minimum",
        F.col("values")[0].alias("q1"),
        F.col("values")[1].alias("median"),
        "mean",
        F.col("values")[2].alias("q3"),
        "maximum",
        "n_missing",
    )


def measure_sd(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample standard deviation ``by..., sd``; NULL for fewer than two values."""
    return df.groupBy(*by).agg(F.stddev_samp(as_missing(F.col(value).cast("double"))).alias("sd"))


def measure_range(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., lo, hi``."""
    x = as_missing(F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
