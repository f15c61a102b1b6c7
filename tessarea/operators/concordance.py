"""Collapsing strata and moving measures from old to new boundaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse_strata(cases: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Sum measures over all strata (sex, site, ...) not among ``keys``.

    ``measures`` maps input to output names.
    """
    return cases.groupBy(*keys).agg(*[F.sum(m).alias(out) for m, out in measures.items()])


def apply_concordance(
    cases: DataFrame,
    concordance: DataFrame,
    cases_key: str,
    old_key: str,
    new_keys: Sequence[str],
    ratio: str,
    measures: Sequence[str],
) -> DataFrame:
    """Measures per new area: each old area is split by its ratios, then summed.

    Old areas without an entry are dropped. Collapse strata first, so that the
    join meets one row per old area, however many cases that area holds.
    """
    links = concordance.select(F.col(old_key).alias(cases_key), *new_keys, ratio)
    return (
        cases.select(cases_key, *measures)
        .join(links, cases_key)
        .groupBy(*new_keys)
        .agg(*[F.sum(F.col(m) * F.col(ratio)).alias(m) for m in measures])
    )
