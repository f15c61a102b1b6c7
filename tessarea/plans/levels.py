"""The whole analysis at any areal level, from input tables to fitted maps.

One function per step takes the level as a parameter. Steps stay lazy; only
tables that several levels or tests read again (cases per area, edges, frames)
are worth a ``cut_lineage`` by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import censored, first_present, ratio
from ..operators.autocorrelation import moran_mc
from ..operators.concordance import apply_concordance, collapse_strata
from ..operators.deprivation import mesh_score, quintile, weighted_score
from ..operators.frame import drop_missing, model_frame
from ..operators.graph import contiguity, drop_islands
from ..operators.hierarchy import (
    apportion_down,
    attach_population,
    crosswalk,
    population_by,
    population_share,
    roll_up,
)
from ..operators.maplayer import map_layer
from ..operators.model import BymFit, fit_all, fitted_sir, residual_table, sir, sir_with_fallback
from ..operators.smoothing import TOL
from ..session import cut_lineage

AREA_KEYS = {
    "Mesh": "MB_CODE16",
    "SA1": "SA1_MAIN16",
    "SA2": "SA2_MAIN16",
    "SA3": "SA3_CODE16",
    "SA4": "SA4_CODE16",
}
LEVELS = tuple(AREA_KEYS)
# The two fits whose expected counts are rounded as well.
ROUNDED_EXPECTED = (("Mesh", "nc"), ("SA4", "wc"))
VARIANTS = ("nc", "wc")

# Published posterior medians of the two variances per level and
# variant (nc: without covariate, wc: with). Reading the first as the spatial
# and the second as the unstructured variance is an assumption.
MEDIAN_VARIANCES = [
    ("Mesh", "nc", 0.08, 0.0013),
    ("SA1", "nc", 0.002, 0.0009),
    ("SA2", "nc", 0.007, 0.0031),
    ("SA3", "nc", 0.0125, 0.0048),
    ("SA4", "nc", 0.0108, 0.019),
    ("Mesh", "wc", 0.26, 0.001),
    ("SA1", "wc", 0.002, 0.0009),
    ("SA2", "wc", 0.0015, 0.0012),
    ("SA3", "wc", 0.004, 0.003),
    ("SA4", "wc", 0.008, 0.005),
]


@dataclass(frozen=True)
class StudyInputs:
    """Input tables with the columns named in the README.

    ``area_scores`` (``sa2_name, irsdscore``) may be left out if the cases carry
    the score.

    The plans read attributes only, so any object with these attributes will do,
    for instance one that builds each table on first use.
    """

    mesh: DataFrame
    population: DataFrame
    cases: DataFrame
    concordance: DataFrame
    scores: DataFrame
    layers: Mapping[str, DataFrame] = field(default_factory=dict)
    area_scores: DataFrame | None = None


def sa2_cases(inputs: StudyInputs) -> DataFrame:
    """``SA2_MAIN16, SA2_NAME16, sa2_count, sa2_expect`` on the new boundaries."""
    collapsed = collapse_strata(
        inputs.cases, ["sa2_name"], {"count": "sa2_count", "expect": "sa2_expect"}
    )
    moved = apply_concordance(
        collapsed,
        inputs.concordance,
        "sa2_name",
        "SA2_NAME_2011",
        ["SA2_MAINCODE_2016", "SA2_NAME_2016"],
        "RATIO",
        ["sa2_count", "sa2_expect"],
    )
    return moved.withColumnsRenamed(
        {"SA2_MAINCODE_2016": "SA2_MAIN16", "SA2_NAME_2016": "SA2_NAME16"}
    )


def stored_cases(inputs: StudyInputs) -> DataFrame:
    """The SA2 case table, written once, so that the levels do not each scan all cases."""
    return cut_lineage(sa2_cases(inputs), "sa2-cases")


def populated_mesh(inputs: StudyInputs) -> DataFrame:
    """Mesh blocks with a population row: codes, SA2 name and ``mesh_population``."""
    people = inputs.population.withColumnRenamed("Person", "mesh_population")
    return attach_population(inputs.mesh, people, "MB_CODE16", "MB_CODE_2016")


def mesh_shares(inputs: StudyInputs) -> DataFrame:
    """Mesh blocks with their share of the SA2 population."""
    return population_share(
        populated_mesh(inputs), "SA2_MAIN16", "mesh_population", "mesh_pop_sum", "mesh_proportion"
    )


def sa1_shares(inputs: StudyInputs) -> DataFrame:
    """SA1 areas with their share of the SA2 population."""
    mesh = populated_mesh(inputs)
    codes = crosswalk(mesh, ["SA1_MAIN16", "SA2_MAIN16", "SA3_CODE16", "SA4_CODE16"])
    # Stored totals: see hierarchy; a parent with very many areas can then be split.
    per_sa1 = cut_lineage(population_by(mesh, "SA1_MAIN16", "mesh_population", "sa1_pop"), "sa1-totals")
    per_sa2 = cut_lineage(population_by(mesh, "SA2_MAIN16", "mesh_population", "sa2_pop"), "sa2-totals")
    return (
        codes.join(per_sa1, "SA1_MAIN16")
        .join(per_sa2, "SA2_MAIN16")
        .withColumn("sa1_prop", ratio(F.col("sa1_pop"), F.col("sa2_pop")))
    )


def level_counts(inputs: StudyInputs, level: str, cases: DataFrame) -> DataFrame:
    """``<area key>, count, expect`` at a level; areas without a share are dropped."""
    names = {"sa2_count": "count", "sa2_expect": "expect"}
    key = AREA_KEYS[level]
    if level == "Mesh":
        # Code and name must both agree, as on the mesh-block map.
        split = apportion_down(
            mesh_shares(inputs), cases, ["SA2_MAIN16", "SA2_NAME16"], "mesh_proportion", names
        )
    elif level == "SA1":
        split = apportion_down(sa1_shares(inputs), cases, ["SA2_MAIN16"], "sa1_prop", names)
    elif level == "SA2":
        split = cases.withColumnsRenamed(names)
    else:
        split = roll_up(inputs.mesh, cases, "SA2_MAIN16", key, list(names)).withColumnsRenamed(names)
    return drop_missing(split.select(key, "count", "expect"), ["count", "expect"])


def level_scores(inputs: StudyInputs, level: str) -> DataFrame:
    """``<area key>, score`` at a level."""
    key = AREA_KEYS[level]
    if level == "Mesh":
        scored = mesh_score(
            inputs.scores, populated_mesh(inputs), "SA1_MAIN16", "SA1_irsdscore", "SA1_pop",
            "mesh_population", "score",
        )
        return drop_missing(scored.select(key, "score"), ["score"])
    if level == "SA2":
        # The score belongs to the old areas and is matched new name to old name,
        # so a renamed area has none.
        source = inputs.cases if inputs.area_scores is None else inputs.area_scores
        by_name = source.select(
            F.col("sa2_name").alias("SA2_NAME_2016"), F.col("irsdscore").alias("score")
        ).distinct()
        codes = inputs.concordance.select(
            F.col("SA2_MAINCODE_2016").alias(key), "SA2_NAME_2016"
        ).distinct()
        return drop_missing(codes.join(by_name, "SA2_NAME_2016").select(key, "score"), ["score"])
    scored = weighted_score(
        inputs.scores, inputs.mesh, "SA1_MAIN16", key, "SA1_irsdscore", "SA1_pop", "score"
    )
    return drop_missing(scored, ["score"])


def _stacked(parts: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """Tables of several levels under one key: ``level, area`` and the columns."""
    return reduce(
        DataFrame.unionByName,
        [
            part.select(
                F.lit(level).alias("level"),
                F.col(AREA_KEYS[level]).cast("bigint").alias("area"),
                *columns,
            )
            for level, part in parts.items()
        ],
    )


def study_frames(
    inputs: StudyInputs, cases: DataFrame, levels: Sequence[str] = LEVELS,
    variants: Sequence[str] = VARIANTS,
) -> DataFrame:
    """Model frames of all levels and variants in one table.

    ``level, variant, area, observed, expected, quintile``; the quintile is NULL
    without covariate, and an area without a score has no row with covariate.
    Counts are derived once per level and then serve both variants.
    """
    counts = _stacked({lv: level_counts(inputs, lv, cases) for lv in levels}, "count", "expect")
    if "wc" in variants:
        scores = _stacked({lv: level_scores(inputs, lv) for lv in levels}, "score")
        # Read three times: for the sketch, for the exact cuts and for the classes.
        scores = cut_lineage(scores, "scores")
        classes = quintile(scores, "score", "quintile", by=["level"])
        counts = counts.join(classes.drop("score"), ["level", "area"], "left")
    else:
        counts = counts.withColumn("quintile", F.lit(None).cast("int"))
    plain = F.struct(F.lit("nc").alias("variant"), F.lit(None).cast("int").alias("quintile"))
    classed = F.struct(F.lit("wc").alias("variant"), F.col("quintile"))
    offered = F.array(*[plain if v == "nc" else classed for v in variants])
    usable = F.filter(offered, lambda v: (v["variant"] == "nc") | v["quintile"].isNotNull())
    rows = counts.select("level", "area", "count", "expect", F.inline(usable))
    rounded = reduce(
        lambda a, b: a | b,
        [(F.col("level") == lv) & (F.col("variant") == va) for lv, va in ROUNDED_EXPECTED],
    )
    framed = model_frame(
        rows, "area", "count", "expect", "quintile", round_expected=rounded, keep=["level", "variant"]
    )
    return framed.select("level", "variant", "area", "observed", "expected", "quintile")


def study_edges(layers: Mapping[str, DataFrame], queen: bool = False) -> DataFrame:
    """``level, src, dst`` of all layers in one job."""
    return contiguity(_stacked(layers, "rings"), "area", queen=queen, by=["level"])


@dataclass(frozen=True)
class Study:
    """Frames and edges, both written to the shared folder, and the fit."""

    frames: DataFrame
    edges: DataFrame
    fit: BymFit

    def fitted(self) -> DataFrame:
        """``level, variant, area, ..., fitted, fitted_sir, residual``."""
        return residual_table(fitted_sir(self.fit.areas))

    def residual_moran(self, level: str, variant: str, nsim: int = 10_000, seed: int = 1) -> DataFrame:
        """Permutation test on the residuals of one fit."""
        one = self.fitted().where((F.col("level") == level) & (F.col("variant") == variant))
        graph = self.edges.where((F.col("level") == level) & (F.col("variant") == variant))
        return moran_mc(one.select("area", F.col("residual").alias("x")), graph, nsim, seed)

    def residual_moran_all(self, nsim: int = 10_000, seed: int = 1) -> DataFrame:
        """The same test for every level and variant, in one job.

        Residuals count to nine places, so those of a saturated fit (a class per
        area) are zero, which gives NULL, and not tested as noise.
        """
        residuals = self.fitted().select("level", "variant", "area", F.round("residual", 9).alias("x"))
        return moran_mc(residuals, self.edges, nsim, seed, by=("level", "variant"))


def run_study(
    inputs: StudyInputs,
    levels: Sequence[str] = LEVELS,
    variants: Sequence[str] = VARIANTS,
    tol: float = TOL,
    max_steps: int = 50,
) -> Study:
    """Prepare, link and fit all levels and variants together."""
    spark = inputs.mesh.sparkSession
    cases = stored_cases(inputs)
    frames = cut_lineage(study_frames(inputs, cases, levels, variants), "frames")
    layers = {lv: inputs.layers[lv] for lv in levels}
    # Each fit has the graph of its own areas: both ends need a frame row.
    present = frames.select("level", "variant", "area")
    edges = (
        study_edges(layers)
        .join(present.withColumnRenamed("area", "src"), ["level", "src"])
        .join(present.withColumnRenamed("area", "dst"), ["level", "variant", "dst"], "left_semi")
    )
    edges = cut_lineage(edges.select("level", "variant", "src", "dst"), "edges")
    modelled = drop_islands(frames, edges, "area", by=["level", "variant"])
    variances = spark.createDataFrame(
        MEDIAN_VARIANCES, "level string, variant string, tau2 double, sigma2 double"
    )
    return Study(frames, edges, fit_all(modelled, edges, variances, tol=tol, max_steps=max_steps))


def sir_map(
    inputs: StudyInputs,
    level: str,
    cases: DataFrame,
    fit: DataFrame | None = None,
    limits: tuple[float, float] = (0.0, 1.6),
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Map table of raw ratios, or of fitted ratios with the raw one as fallback."""
    key = AREA_KEYS[level]
    raw = sir(level_counts(inputs, level, cases), "count", "expect", "sir")
    if fit is not None:
        ratios = fitted_sir(fit.withColumnRenamed("area", key))
        raw = sir_with_fallback(raw.select(key, "sir"), ratios, key, "sir", "fitted_sir", "sir")
    return map_layer(raw, inputs.layers[level], key, "sir", limits, box)


def fitted_layers(
    inputs: StudyInputs,
    cases: DataFrame,
    fits: DataFrame,
    levels: Sequence[str] = LEVELS,
    variants: Sequence[str] = VARIANTS,
    uppers: Sequence[float] = (1.6, 2.0),
) -> DataFrame:
    """Map tables of fitted ratios for all levels, variants and scales: ``level, variant, upper, area, sir, rings``.

    ``fits`` has ``level, variant, area, fitted, expected``, for instance as read from
    stored fits. Areas without a fit show their raw ratio; values outside ``[0, upper]`` are missing.
    Ratios and polygons of all levels meet in one join each; scales are added to the joined row.
    """
    counts = _stacked({lv: level_counts(inputs, lv, cases) for lv in levels}, "count", "expect")
    raw = sir(counts, "count", "expect", "_raw").select("level", "area", "_raw")
    offered = raw.select("*", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    keys = ["level", "variant", "area"]
    ratios = fitted_sir(fits).select(*keys, "fitted_sir")
    shown = offered.join(ratios, keys, "left").withColumn("sir", first_present(F.col("fitted_sir"), F.col("_raw")))
    shapes = _stacked({lv: inputs.layers[lv] for lv in levels}, "rings")
    scales = F.explode(F.array(*[F.lit(float(u)) for u in uppers])).alias("upper")
    table = shown.join(shapes, ["level", "area"]).select("*", scales)
    return table.select(
        "level", "variant", "upper", "area", censored(F.col("sir"), F.lit(0.0), F.col("upper")).alias("sir"), "rings"
    )


def state_only(inputs: StudyInputs, column: str, value: str) -> StudyInputs:
    """Inputs limited to one state, by a filter the layer scans can push down."""
    return replace(
        inputs,
        mesh=inputs.mesh.where(F.col(column) == value),
        layers={
            lv: layer.where(F.col(column) == value) if column in layer.columns else layer
            for lv, layer in inputs.layers.items()
        },
    )
