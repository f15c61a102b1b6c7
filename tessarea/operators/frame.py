"""Projection, filtering and row-set operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import code_number, code_text, is_present, round_half_even, zero_replaced
from .quantiles import keys_at


def normalise_codes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Bring text or factor codes to BIGINT keys."""
    return df.withColumns({c: code_number(F.col(c)) for c in columns})


def codes_as_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Bring numeric codes to text keys."""
    return df.withColumns({c: code_text(F.col(c)) for c in columns})


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Equality filter, e.g. one state or one disease site."""
    return df.where(F.col(column) == F.lit(value))


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows where any of the columns is NULL or, in a measure, NaN."""
    kept = df
    for c in columns:
        is_measure = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
        kept = kept.where(is_present(F.col(c)) if is_measure else F.col(c).isNotNull())
    return kept


def replace_zero(df: DataFrame, column: str, eps: float = 0.001) -> DataFrame:
    return df.withColumn(column, zero_replaced(F.col(column), eps))


def model_frame(
    df: DataFrame,
    key: str,
    count: str,
    expect: str,
    covariate: str | None = None,
    eps: float = 0.001,
    round_expected: bool | Column = False,
    keep: Iterable[str] = (),
) -> DataFrame:
    """``key, observed, expected[, covariate]`` as the models take them.

    Observed counts are rounded half-to-even. Expected counts are rounded only
    on request (the mesh-block fit without covariate and the SA4 fit with it) or
    in the rows a condition names, and zeros become ``eps`` so that their
    logarithm is finite.
    """
    expected: Column = F.col(expect)
    if isinstance(round_expected, Column):
        expected = F.when(round_expected, round_half_even(expected)).otherwise(expected)
    elif round_expected:
        expected = round_half_even(expected)
    columns = [
        F.col(key),
        round_half_even(F.col(count)).alias("observed"),
        zero_replaced(expected, eps).alias("expected"),
    ]
    if covariate is not None:
        columns.append(F.col(covariate))
    return df.select(*columns, *keep)


def row_slice(df: DataFrame, order_by: str, lo: int, hi: int) -> DataFrame:
    """Rows ``lo..hi`` (from 1, both included) in the order of a unique key of any type.

    Rows with a NULL key have no position and are never in a slice. The two bounding
    keys are found first, and the slice is then a key-range filter: no task ever
    sorts or holds the whole table.
    """
    if not 1 <= lo <= hi:
        raise ValueError("need 1 <= lo <= hi")
    first, last = keys_at(df, order_by, [lo, hi])
    if first is None:
        return df.limit(0)
    kind = df.schema[order_by].dataType
    kept = df.where(F.col(order_by) >= F.lit(first).cast(kind))
    return kept if last is None else kept.where(F.col(order_by) <= F.lit(last).cast(kind))


def append_rows(df: DataFrame, *others: DataFrame, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Union by name; columns an addition lacks take the value in ``fill``."""
    out = df
    for other in others:
        missing = {
            c: F.lit((fill or {}).get(c)).cast(df.schema[c].dataType)
            for c in df.columns
            if c not in other.columns
        }
        out = out.unionByName(other.withColumns(missing) if missing else other)
    return out
