"""Poisson rate models and fit tables; ``smoothing`` fits the spatial model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import first_present, is_present, log_positive, ratio
from ..session import cut_lineage
from .smoothing import BymFit, bucketed_copy, bym_map, fit_all  # noqa: F401


def sir(df: DataFrame, observed: str, expected: str, out: str = "sir") -> DataFrame:
    """Standardised incidence ratio; NULL where nothing is expected."""
    return df.withColumn(out, ratio(F.col(observed), F.col(expected)))


def poisson_rates(frame: DataFrame, covariate: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Maximum-likelihood coefficients in closed form: ``by..., term, estimate``.

    Without covariate: intercept ``ln(sum O / sum E)``. With one: the intercept is
    that of the lowest level, every other level q has ``ln(O_q / E_q) - intercept``
    and the term name ``<covariate><q>``. A level without cases has no finite
    estimate and gives NULL.
    """
    by = list(by)
    observed, expected = F.sum("observed"), F.sum("expected")
    if covariate is None:
        return frame.groupBy(*by).agg(
            F.lit("(Intercept)").alias("term"), log_positive(ratio(observed, expected)).alias("estimate")
        )
    levels = (
        frame.where(F.col(covariate).isNotNull())
        .groupBy(*by, covariate)
        .agg(log_positive(ratio(observed, expected)).alias("_rate"))
    )
    # Over the few rows left per model: one per level of the factor.
    lowest = W.partitionBy(*by).orderBy(covariate)
    reference = F.first("_rate").over(lowest)
    is_reference = F.row_number().over(lowest) == 1
    return levels.select(
        *by,
        F.when(is_reference, F.lit("(Intercept)"))
        .otherwise(F.concat(F.lit(covariate), F.col(covariate).cast("string")))
        .alias("term"),
        F.when(is_reference, F.col("_rate")).otherwise(F.col("_rate") - reference).alias("estimate"),
    )


def poisson_glm(frame: DataFrame, features: Sequence[str], max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """The same model for any factor covariates, fitted by ``pyspark.ml``: ``term, estimate``.

    Factors are dummy-coded against their lowest level, in the order of their type.
    Rows with a missing factor are left out; an expected count of zero is an error.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark = frame.sparkSession
    if not features:
        raise ValueError("without features use poisson_rates, which is exact")
    offset = F.when(F.col("expected") > 0, F.ln("expected")).otherwise(
        F.raise_error(F.lit("expected counts must be positive: see replace_zero"))
    )
    indexed = frame.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])).withColumn("_offset", offset)
    # The levels of a factor in their own order; each is a coefficient. The encoder
    # drops the last category, so the lowest level has the highest number.
    levels = {f: _levels(frame, f) for f in features}
    for f, values in levels.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(f))
        indexed = indexed.withColumn(f"_{f}_i", (F.lit(len(values)) - place).cast("double"))
    encoder = OneHotEncoder(
        inputCols=[f"_{f}_i" for f in features], outputCols=[f"_{f}_v" for f in features], dropLast=True
    )
    assembled = VectorAssembler(
        inputCols=encoder.getOutputCols(), outputCol="_x"
    ).transform(encoder.fit(indexed).transform(indexed))
    fitted = GeneralizedLinearRegression(
        family="poisson",
        link="log",
        labelCol="observed",
        featuresCol="_x",
        offsetCol="_offset",
        maxIter=max_iter,
        tol=tol,
    ).fit(assembled)
    terms = [f"{f}{level}" for f in features for level in reversed(levels[f][1:])]
    rows = [("(Intercept)", float(fitted.intercept))]
    rows += [(t, float(c)) for t, c in zip(terms, fitted.coefficients)]
    return spark.createDataFrame(rows, "term string, estimate double")


# The solver's bound on columns of a design; a factor with more levels is refused.
MOST_COLUMNS = 4096


def _levels(frame: DataFrame, factor: str) -> list:
    """Levels of a factor in the order of their type, at most ``MOST_COLUMNS``."""
    found = frame.select(factor).distinct().where(F.col(factor).isNotNull()).orderBy(factor).limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{factor} has over {MOST_COLUMNS} levels: a continuous covariate?")
    return [row[0] for row in found]


def poisson_design(
    frame: DataFrame,
    factors: Sequence[str] = (),
    continuous: Sequence[str] = (),
    interactions: Sequence[Sequence[str]] = (),
    max_iter: int = 50,
    tol: float = 1e-12,
) -> DataFrame:
    """Rate model of factors, continuous covariates and interactions: ``term, estimate``.

    Factors are dummy-coded against their lowest level, in the order of their type.
    An interaction names columns of the first two kinds; its terms join theirs by ``:``.
    Rows with a missing covariate are left out; an expected count that is not positive
    is an error. Only the levels of factors, and sums per pair of design columns, reach the driver.
    """
    from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    used = [*factors, *continuous]
    if not used:
        raise ValueError("without covariates use poisson_rates, which is exact")
    unknown = {c for group in interactions for c in group} - set(used)
    if unknown:
        raise ValueError(f"interactions of columns that are no covariates: {sorted(unknown)}")
    offset = F.when(F.col("expected") > 0, F.ln("expected")).otherwise(
        F.raise_error(F.lit("expected counts must be positive: see replace_zero"))
    )
    present = [F.col(f).isNotNull() for f in factors] + [is_present(F.col(c).cast("double")) for c in continuous]
    known = reduce(lambda a, b: a & b, present)
    table = frame.where(known).withColumn("_offset", offset)
    terms, place = {}, {}
    for f in factors:
        levels = _levels(frame.where(known), f)
        # The encoder drops the last category, so the lowest level has the highest number.
        at = F.lit(len(levels)) - F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(f))
        table = table.withColumn(f"_{f}_i", at.cast("double"))
        terms[f], place[f] = [f"{f}{v}" for v in reversed(levels[1:])], f"_{f}_v"
    for c in continuous:
        table = table.withColumn(f"_{c}_v", F.col(c).cast("double"))
        terms[c], place[c] = [c], f"_{c}_v"
    # A factor of one level has no column, and neither have its interactions.
    coded = [f for f in factors if terms[f]]
    if coded:
        encoder = OneHotEncoder(inputCols=[f"_{f}_i" for f in coded], outputCols=[place[f] for f in coded], dropLast=True)
        table = encoder.fit(table).transform(table)
    columns = {place[c]: terms[c] for c in used if terms[c]}
    for k, group in enumerate(interactions):
        if all(terms[c] for c in group):
            table = Interaction(inputCols=[place[c] for c in group], outputCol=f"_x{k}").transform(table)
            columns[f"_x{k}"] = [":".join(parts) for parts in product(*[terms[c] for c in group])]
    names = [term for group in columns.values() for term in group]
    if len(names) >= MOST_COLUMNS:
        raise ValueError(f"the design has {len(names)} columns; the solver takes fewer than {MOST_COLUMNS}")
    fitted = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="observed", featuresCol="_x", offsetCol="_offset", maxIter=max_iter, tol=tol
    ).fit(VectorAssembler(inputCols=list(columns), outputCol="_x").transform(table))
    estimates = [("(Intercept)", float(fitted.intercept)), *zip(names, map(float, fitted.coefficients))]
    return frame.sparkSession.createDataFrame(estimates, "term string, estimate double")


def rates_fit(frame: DataFrame, covariate: str, by: Sequence[str] = ()) -> DataFrame:
    """Fitted counts of the closed-form rate model: the frame with ``fitted``."""
    by = list(by)
    rates = frame.groupBy(*by, covariate).agg(
        ratio(F.sum("observed"), F.sum("expected")).alias("_rate")
    )
    return (
        frame.join(cut_lineage(rates, "rates"), [*by, covariate])
        .withColumn("fitted", F.col("expected") * F.col("_rate"))
        .drop("_rate")
    )


def fitted_sir(fit: DataFrame, expected: str = "expected", out: str = "fitted_sir") -> DataFrame:
    """Fitted count over expected count."""
    return fit.withColumn(out, ratio(F.col("fitted"), F.col(expected)))


def residual_table(fit: DataFrame, kind: str = "pearson", out: str = "residual") -> DataFrame:
    """Response (``O - mu``) or Pearson (``(O - mu) / sqrt(mu)``) residuals."""
    gap = F.col("observed") - F.col("fitted")
    if kind == "response":
        return fit.withColumn(out, gap)
    if kind == "pearson":
        return fit.withColumn(out, ratio(gap, F.when(F.col("fitted") > 0, F.sqrt("fitted"))))
    raise ValueError("kind must be 'response' or 'pearson'")


def observed_fitted(frame: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    """Pairs of observed and fitted counts, matched by key and never by position."""
    return frame.select(key, "observed").join(fit.select(key, "fitted"), key)


def sir_with_fallback(
    stats: DataFrame, fit: DataFrame, key: str, raw: str, fitted: str, out: str
) -> DataFrame:
    """Fitted ratio where a fit exists, the raw ratio elsewhere; all areas are kept."""
    joined = stats.join(fit.select(key, F.col(fitted).alias("_fitted")), key, "left")
    return joined.withColumn(out, first_present(F.col("_fitted"), F.col(raw))).drop("_fitted")

