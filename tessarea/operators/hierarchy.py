"""Nested areas: populations, shares, roll-up and apportionment.

Totals are aggregated (combined map-side), stored and joined back. A window over
the parent would put all members of one large parent into a single task. Stored
totals of known size are broadcast if small, so the members are not shuffled;
otherwise a hot parent is split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import cut_lineage


def attach_population(
    mesh: DataFrame, population: DataFrame, mesh_key: str, population_key: str
) -> DataFrame:
    """Hierarchy rows that have a population, with it; keys may be named differently."""
    return mesh.join(population.withColumnRenamed(population_key, mesh_key), mesh_key)


def population_by(mesh: DataFrame, area: str, population: str, name: str) -> DataFrame:
    """Population total per area."""
    return mesh.groupBy(area).agg(F.sum(population).alias(name))


def attach_total(members: DataFrame, area: str, measure: str, name: str) -> DataFrame:
    """Every member row with the total of its area."""
    totals = cut_lineage(population_by(members, area, measure, name), "totals")
    return members.join(totals, area)


def population_share(
    members: DataFrame, parent: str, population: str, total: str, share: str
) -> DataFrame:
    """Every member's share of its parent's total; NULL where that total is zero."""
    whole = attach_total(members, parent, population, total)
    return whole.withColumn(share, ratio(F.col(population), F.col(total)))


def share_check(shares: DataFrame, parent: str, share: str, tol: float = 1e-9) -> DataFrame:
    """Sum of shares per parent and whether it is 1 within ``tol``."""
    sums = shares.groupBy(parent).agg(F.sum(share).alias("share_sum"))
    return sums.withColumn(
        "ok", F.coalesce(F.abs(F.col("share_sum") - 1.0) <= tol, F.lit(False))
    )


def crosswalk(mesh: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct combinations of area codes."""
    return mesh.select(*levels).distinct()


def roll_up(
    hierarchy: DataFrame, cases: DataFrame, from_key: str, to_key: str, measures: Iterable[str],
    cases_key: str | None = None,
) -> DataFrame:
    """Sum measures of a lower level per area of a higher one."""
    links = crosswalk(hierarchy, [from_key, to_key])
    lower = cases if cases_key is None else cases.withColumnRenamed(cases_key, from_key)
    return (
        links.join(lower, from_key)
        .groupBy(to_key)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def level_totals(members: DataFrame, levels: Mapping[str, str], measures: Iterable[str]) -> DataFrame:
    """Totals of every level of a hierarchy from one scan: ``level, area`` and the measures.

    ``levels`` maps the name of a level to its area column. Each row meets every level
    before the map-side combine, so a large area shuffles one row per task and level.
    Members without a code at a level are that level's NULL area.
    """
    names = list(levels)
    keys = [levels[name] for name in names]
    totals = members.groupingSets([[key] for key in keys], *keys).agg(
        F.grouping_id().alias("_set"), *[F.sum(m).alias(m) for m in measures]
    )
    # In a grouping set's number the bit of every column but its own is one.
    everything = 2 ** len(keys) - 1
    level, area = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for place, (name, key) in enumerate(zip(names, keys)):
        here = F.col("_set") == everything - 2 ** (len(keys) - 1 - place)
        level = F.when(here, F.lit(name)).otherwise(level)
        area = F.when(here, F.col(key).cast("bigint")).otherwise(area)
    return totals.select(level.alias("level"), area.alias("area"), *measures)


def apportion_down(
    shares: DataFrame, cases: DataFrame, on: Sequence[str], share: str, measures: dict[str, str]
) -> DataFrame:
    """Split parent measures over members by share; ``measures`` maps parent name to result name.

    ``on`` may name several keys (code and name): then both must agree.
    """
    joined = shares.join(cases, list(on))
    return joined.withColumns(
        {out: F.col(m) * F.col(share) for m, out in measures.items()}
    ).drop(*measures)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, a missing value counted as one more."""
    return (
        df.select(column)
        .distinct()
        .agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col(column).isNull()).alias("n_missing"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
