"""Deprivation scores, quantile classes and factor levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio, round_half_even
from ..session import cut_lineage
from .quantiles import quantiles

FIFTHS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def weighted_score(
    scores: DataFrame,
    hierarchy: DataFrame,
    unit: str,
    level: str,
    score: str,
    population: str,
    out: str,
    weights: str = "per_mesh_row",
) -> DataFrame:
    """Population-weighted score per area of ``level``, rounded half-to-even.

    ``per_mesh_row`` weights a unit by its population times its number of rows in
    the one-row-per-mesh-block hierarchy, which is what a join without ``distinct``
    gives; ``per_sa1`` counts every unit once. Hierarchy rows are counted before
    the join, so the fan-out is never materialised, and numerator and denominator
    are sums of whole numbers, so the result does not depend on row order.
    """
    if weights not in ("per_mesh_row", "per_sa1"):
        raise ValueError("weights must be 'per_mesh_row' or 'per_sa1'")
    members = hierarchy.groupBy(*dict.fromkeys([unit, level])).agg(F.count(F.lit(1)).alias("_rows"))
    n_rows = F.col("_rows") if weights == "per_mesh_row" else F.lit(1)
    weight = F.col(population) * n_rows
    return (
        scores.select(unit, score, population)
        .join(members, unit)
        .groupBy(level)
        .agg(ratio(F.sum(F.col(score) * weight), F.sum(weight)).alias("_mean"))
        .select(level, round_half_even(F.col("_mean")).alias(out))
    )


def mesh_score(
    scores: DataFrame, mesh: DataFrame, unit: str, score: str, population: str,
    mesh_population: str, out: str,
) -> DataFrame:
    """Mesh rows with the unit's score apportioned by population.

    This is a share of the score, not an average, exactly as the mesh-block
    analysis uses it.
    """
    return mesh.join(scores.select(unit, score, population), unit).withColumn(
        out, ratio(F.col(score) * F.col(mesh_population), F.col(population))
    )


def quantile_cuts(
    df: DataFrame, value: str, probs: Sequence[float] = FIFTHS, by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles in long form: ``by..., prob, cut``."""
    found = quantiles(df, value, probs, by)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("values").alias("cut"))
    return found.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.prob", "_p.cut")


def quintile(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Class 1..5 by the fifths of ``value``; a value on a cut belongs to the lower class.

    Ties share a class, which equal-count tiling would break. Missing values get
    a NULL class. With ``by`` the fifths are those of each group.
    """
    inner = FIFTHS[1:-1]
    cuts = quantiles(df, value, inner, by)
    if by:
        stored = cut_lineage(cuts.select(*by, F.col("values").alias("_cuts")), "cuts")
        with_cuts = df.join(stored, list(by), "left")
    else:
        with_cuts = df.withColumn("_cuts", cuts.select("values").scalar())
    v = F.col(value)
    klass = reduce(
        lambda chain, i: chain.when(v <= F.col("_cuts")[i], i + 1),
        range(1, len(inner)),
        F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None)).when(v <= F.col("_cuts")[0], 1),
    ).otherwise(len(inner) + 1)
    return with_cuts.withColumn(out, klass.cast("int")).drop("_cuts")


def factor_levels(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct levels; the first is the reference level."""
    levels = df.where(F.col(column).isNotNull()).select(column).distinct()
    least = levels.agg(F.min(column)).scalar()
    return levels.withColumn("is_reference", F.col(column) == least).orderBy(column)
