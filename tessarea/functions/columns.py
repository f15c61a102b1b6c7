"""Scalar column expressions with R-like missing-value behaviour.

Missing means NULL or NaN throughout, as R's ``is.na`` is true for both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def is_present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def as_missing(value: Column) -> Column:
    """NaN becomes NULL, other values stay."""
    return F.nanvl(value, F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0)


def zero_replaced(value: Column, eps: float) -> Column:
    return F.when(value == 0, F.lit(float(eps))).otherwise(value)


def log_positive(value: Column) -> Column:
    """Natural log; NULL where R would give -Inf or NaN."""
    return F.when(value > 0, F.ln(value))


def censored(value: Column, lo: float, hi: float) -> Column:
    """Values outside ``[lo, hi]`` become missing, as on a limited map scale."""
    return F.when(value.between(lo, hi), value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*[as_missing(v) for v in values])


def code_number(value: Column) -> Column:
    """Text, factor or number to a BIGINT code; what is no whole number becomes NULL.

    ``305011105.0``, ``3e4`` and a DOUBLE are read as the whole numbers they are.
    """
    number = F.trim(value.cast("string")).try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def code_text(value: Column) -> Column:
    return value.cast("bigint").cast("string")
