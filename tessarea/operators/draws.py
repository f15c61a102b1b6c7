"""Posterior draws in long form: ``level, variant, param, idx, iter, value``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import cut_lineage
from .quantiles import quantiles

KEYS = ("level", "variant", "param", "idx")
# Width of a band of log densities; exp(BAND) times any number of draws is finite.
BAND = 300.0
# The band of draws under which the observed count is impossible.
LOWEST_BAND = -(10**12)
# Above the number of any cell of a positive double, so that cells of both signs sort by value.
CELL_ZERO = 10**12
# Reported quantiles, with their column names.
SUMMARY = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975}


def thin_draws(draws: DataFrame, burnin: int, thin: int) -> DataFrame:
    """Every ``thin``-th draw after the burn-in; a filter, no shuffle."""
    after = F.col("iter") - burnin
    return draws.where((after > 0) & (after % thin == 0))


def posterior_summary(draws: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per parameter: ``n_draws, mean, sd, naive_se`` and five quantiles."""
    keys = list(keys)
    moments = (F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    return quantiles(draws, "value", list(SUMMARY.values()), keys, moments).select(
        *keys,
        F.col("n").alias("n_draws"),
        "mean",
        "sd",
        (F.col("sd") / F.sqrt("n")).alias("naive_se"),
        *[F.col("values")[i].alias(name) for i, name in enumerate(SUMMARY)],
    )


def summary_state(draws: DataFrame, keys: Sequence[str] = KEYS, relative: float = 1e-3) -> DataFrame:
    """What a summary needs of a chain: counts and moments per cell of values.

    ``keys..., cell, n, mean, var``. Any two values of a cell differ at most by the factor
    ``1 + relative``, and cells are numbered in the order of their values; their number
    depends on the range of the values, not on the number of draws. Draws that are
    missing or infinite do not count.
    """
    value = F.col("value").cast("double")
    rank = F.ceil(F.ln(F.abs(value)) / math.log1p(relative)).cast("bigint") + CELL_ZERO
    cell = F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * rank).cast("bigint")
    known = draws.where(F.abs(value) < float("inf"))
    return known.groupBy(*keys, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")
    )


def merge_summaries(states: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """One state of several chains' states, all made with the same ``relative``."""
    return _merged(states, [*keys, "cell"], [])


def summary_of(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``n_draws, mean, sd, naive_se`` and five quantiles from a merged state.

    Moments are those of all draws. A quantile is the mean of the cell that holds the
    draw of rank ``floor(p * (n - 1)) + 1``, so within ``relative`` of that draw.
    """
    keys = list(keys)
    all_cells = Window.partitionBy(*keys)
    n, mean = F.col("n"), F.col("mean")
    # A window over cells, whose number the range of the values bounds.
    ranked = state.withColumns(
        {
            "_upto": F.sum(n).over(all_cells.orderBy("cell")),
            "_all": F.sum(n).over(all_cells),
            "_mean": F.sum(n * mean).over(all_cells) / F.sum(n).over(all_cells),
        }
    )

    def at(p: float) -> Column:
        reached = F.col("_upto") >= F.floor(F.lit(p) * (F.col("_all") - 1)) + 1
        return F.min(F.when(reached, F.struct("cell", "mean")))["mean"]

    spread = F.sum(n * (F.col("var") + F.pow(mean - F.col("_mean"), F.lit(2))))
    return (
        ranked.groupBy(*keys)
        .agg(
            F.sum(n).alias("n_draws"),
            F.first("_mean").alias("mean"),
            F.sqrt(ratio(spread, F.sum(n) - 1)).alias("sd"),
            *[at(p).alias(name) for name, p in SUMMARY.items()],
        )
        .withColumn("naive_se", F.col("sd") / F.sqrt("n_draws"))
        .select(*keys, "n_draws", "mean", "sd", "naive_se", *SUMMARY)
    )


def mixing(draws: DataFrame, batches: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Batch-means diagnostics per parameter: ``n_draws, n_batches, mcse, ess, geweke_z``.

    Iterations are cut into ``batches`` equal spans. The Monte Carlo error is that
    of the batch means, the effective size is variance over squared error, and
    Geweke's z compares the first tenth of the span with the last half, its errors
    again taken from batch means. This is not the spectral estimate of other tools.
    """
    keys = list(keys)
    span = draws.groupBy(*keys).agg(F.min("iter").alias("_from"), F.max("iter").alias("_to"))
    span = cut_lineage(span, "span")
    position = ratio(F.col("iter") - F.col("_from"), F.col("_to") - F.col("_from") + 1)
    # Partial sums per batch: a parameter of any length shuffles `batches` rows per task.
    per_batch = (
        draws.join(span, keys)
        .groupBy(*keys, F.floor(position * batches).alias("_batch"))
        .agg(
            F.count("value").alias("_n"),
            F.avg("value").alias("_mean"),
            F.var_pop("value").alias("_var"),
        )
    )
    early = F.col("_batch") < F.lit(batches / 10.0)
    late = F.col("_batch") >= F.lit(batches / 2.0)
    n, mean = F.col("_n"), F.col("_mean")

    def weighted_mean(where) -> Column:
        return ratio(F.sum(F.when(where, n * mean)), F.sum(F.when(where, n)))

    def batch_error2(where) -> Column:
        """Squared error of the mean: variance of the batch means over their number."""
        return F.var_samp(F.when(where, mean)) / F.count_if(where)

    everything = F.lit(True)
    summed = per_batch.groupBy(*keys).agg(
        F.sum("_n").alias("n_draws"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sqrt(batch_error2(everything)).alias("mcse"),
        F.sum(n * F.col("_var")).alias("_within"),
        F.sum(n * mean * mean).alias("_raw"),
        weighted_mean(everything).alias("_mean"),
        weighted_mean(early).alias("_early"),
        weighted_mean(late).alias("_late"),
        (batch_error2(early) + batch_error2(late)).alias("_error2"),
    )
    total = F.col("n_draws")
    variance = ratio(
        F.col("_within") + F.col("_raw") - total * F.col("_mean") * F.col("_mean"), total - 1
    )
    return summed.select(
        *keys,
        "n_draws",
        "n_batches",
        "mcse",
        ratio(variance, F.col("mcse") * F.col("mcse")).alias("ess"),
        ratio(F.col("_early") - F.col("_late"), F.sqrt("_error2")).alias("geweke_z"),
    )


def trace(draws: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Draws in iteration order per parameter, for a trace plot (a range-partitioned sort)."""
    return draws.select(*keys, "iter", "value").orderBy(*keys, "iter")


def density_bins(draws: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Histogram of every parameter over ``n`` equal bins: ``bin, n_draws, density``."""
    keys = list(keys)
    ends = draws.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("value").alias("_all")
    )
    ends = cut_lineage(ends, "ends")
    width = (F.col("_hi") - F.col("_lo")) / n
    place = F.floor(ratio(F.col("value") - F.col("_lo"), width)) + 1
    return (
        draws.join(ends, keys)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(1)), F.lit(n)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n_draws"),
            F.first(width).alias("_width"),
            F.first("_lo").alias("_lo"),
            F.first("_all").alias("_all"),
        )
        .select(
            *keys,
            "bin",
            (F.col("_lo") + F.col("_width") * (F.col("bin") - 0.5)).alias("midpoint"),
            "n_draws",
            ratio(F.col("n_draws"), F.col("_all") * F.col("_width")).alias("density"),
        )
    )


def criteria_state(draw_fits: DataFrame, frame: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """What :func:`fit_criteria` needs of a chain: sums per area and band of log density.

    ``by..., key, observed, band, n, mu, mean, var, up, down``. A chain is read once;
    states of several chains are put together by :func:`merge_criteria` without the draws.
    """
    by = list(by)
    mu, o = F.col("fitted"), F.col("observed")
    # Shifted log density: log p(o | mu) - log p(o | o), never above zero.
    at_peak = F.when(o > 0, o * F.ln(o) - o).otherwise(0.0)
    # Exploded draws look as small as what they were exploded from, so neither side may be
    # broadcast: a merge join, whose skewed keys adaptive execution can still split.
    draws = draw_fits.select(*by, key, "fitted").join(frame.select(*by, key, "observed").hint("merge"), [*by, key])
    impossible = F.lit(float("-inf"))
    density = F.when(o == 0, -mu).when(mu > 0, o * F.ln(mu) - mu - at_peak).otherwise(impossible)
    band = F.when(F.col("_l") == impossible, F.lit(LOWEST_BAND)).otherwise(F.floor(F.col("_l") / BAND))
    shifted = draws.withColumn("_l", density).withColumn("band", band)
    inside = F.col("_l") - F.col("band") * BAND
    return shifted.groupBy(*by, key, "observed", "band").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(mu).alias("mu"),
        F.avg("_l").alias("mean"),
        F.var_pop("_l").alias("var"),
        F.sum(F.exp(inside)).alias("up"),
        F.sum(F.exp(-inside)).alias("down"),
    )


def _merged(states: Sequence[DataFrame], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """States under each other, rows of one key put together: ``n, mean, var`` and sums."""
    n, mean = F.col("n"), F.col("mean")
    rows = reduce(DataFrame.unionByName, states).groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        (F.sum(n * mean) / F.sum(n)).alias("_mean"),
        F.collect_list(F.struct("n", "mean", "var")).alias("_parts"),  # one per state
        *[F.sum(c).alias(c) for c in sums],
    )
    spread = F.aggregate(
        "_parts", F.lit(0.0), lambda acc, p: acc + p["n"] * (p["var"] + F.pow(p["mean"] - F.col("_mean"), F.lit(2)))
    )
    return rows.select(
        *keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), (spread / F.col("_n")).alias("var"), *sums
    )


def merge_criteria(states: Sequence[DataFrame], key: str, by: Sequence[str] = ()) -> DataFrame:
    """One state of several chains' states, all of the same frame."""
    return _merged(states, [*by, key, "observed", "band"], ["mu", "up", "down"])


def fit_criteria(draw_fits: DataFrame, frame: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """DIC, WAIC and LMPL per model from ``by..., key, iter, fitted``.

    Every area's draws are reduced to a few sums before the areas are added up.
    Log densities are shifted by the density at the area's own observed count and
    summed as exponentials per band of ``BAND`` log units, relative to the band;
    the few bands of an area are put together last. So neither a poor draw nor a
    large count can overflow or vanish. A draw of zero is certain where nothing was
    observed and impossible elsewhere; one impossible draw makes DIC and WAIC
    infinite and the LMPL minus infinity.
    """
    return criteria_of(criteria_state(draw_fits, frame, key, by), key, by)


def criteria_of(state: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """DIC, WAIC and LMPL per model from a state of one chain or of several."""
    by = list(by)
    area = [*by, key, "observed"]
    o = F.col("observed")
    impossible = F.lit(float("-inf"))
    packed = state.groupBy(*area).agg(
        F.sum("n").alias("_n"),
        F.sum("mu").alias("_mu"),
        F.sum(F.col("n") * F.col("mean")).alias("_sum"),
        F.max("band").alias("_top"),
        F.min("band").alias("_low"),
        F.collect_list(F.struct("band", "n", "mean", "var", "up", "down")).alias("_bands"),
    )

    def total(term: Callable[[Column], Column]) -> Column:
        return F.aggregate("_bands", F.lit(0.0), lambda acc, band: acc + term(band))

    n = F.col("_n")
    per_area = packed.withColumn("_mean", F.col("_sum") / n).select(
        *area,
        "_mean",
        (F.col("_mu") / n).alias("_mu"),
        F.when(F.col("_mean") == impossible, F.lit(float("inf")))
        .otherwise(
            ratio(
                total(lambda b: b["n"] * (b["var"] + F.pow(b["mean"] - F.col("_mean"), F.lit(2)))), n - 1
            )
        )
        .alias("_var"),
        (
            F.ln(total(lambda b: b["up"] * F.exp((b["band"] - F.col("_top")) * BAND)) / n)
            + F.col("_top") * BAND
        ).alias("_lppd"),
        (
            F.ln(total(lambda b: b["down"] * F.exp((F.col("_low") - b["band"]) * BAND)) / n)
            - F.col("_low") * BAND
        ).alias("_inverse"),
    )
    log_factorial = log_gamma_plus_one(o)
    base = F.when(o > 0, o * F.ln(o) - o).otherwise(0.0) - log_factorial
    at_mean = (
        F.when(o == 0, -F.col("_mu"))
        .when(F.col("_mu") > 0, o * F.ln("_mu") - F.col("_mu") - log_factorial)
        .otherwise(impossible)
    )
    sums = per_area.groupBy(*by).agg(
        (-2 * F.sum(F.col("_mean") + base)).alias("_dbar"),
        (-2 * F.sum(at_mean)).alias("_dhat"),
        F.sum(F.col("_lppd") + base).alias("_lppd"),
        F.sum("_var").alias("p_waic"),
        F.sum(base - F.col("_inverse")).alias("lmpl"),
    )
    return sums.select(
        *by,
        (2 * F.col("_dbar") - F.col("_dhat")).alias("dic"),
        (F.col("_dbar") - F.col("_dhat")).alias("p_dic"),
        (-2 * (F.col("_lppd") - F.col("p_waic"))).alias("waic"),
        "p_waic",
        "lmpl",
    )


def log_gamma_plus_one(o) -> Column:
    """``ln(o!)`` for whole counts: exact logs up to 9, Stirling's series beyond.

    The truncation error from 10 on is below 1e-10.
    """
    small = F.ln(
        F.element_at(
            F.array(*[F.lit(float(f)) for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)]),
            F.greatest(F.least(o, F.lit(9.0)), F.lit(0.0)).cast("int") + 1,
        )
    )
    inv = 1.0 / o
    inv3 = inv * inv * inv
    series = (
        o * F.ln(o)
        - o
        + 0.5 * F.ln(2 * F.pi() * o)
        + inv / 12
        - inv3 / 360
        + inv3 * inv * inv / 1260
    )
    return F.when(o < 10, small).otherwise(series)


def interval_table(df: DataFrame, key: str, triples: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Wide interval columns to rows ``key, parameter, median, lower, upper, consistent``.

    ``triples`` maps a parameter to its median, lower and upper column; a row is
    consistent if ``lower <= median <= upper``.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("parameter"),
                F.col(m).alias("median"),
                F.col(lo).alias("lower"),
                F.col(hi).alias("upper"),
            )
            for p, (m, lo, hi) in triples.items()
        ]
    )
    return df.select(key, F.inline(rows)).withColumn(
        "consistent",
        (F.col("lower") <= F.col("median")) & (F.col("median") <= F.col("upper")),
    )
