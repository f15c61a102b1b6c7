"""Registry of queries, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .tables import Tables

DIGITS = 6
# Rounded to this first, so that noise in the last bits cannot split an exact tie.
GUARD = 9


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(Tables(spark, sf_dir)))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, since sums depend on order; no negative zero."""
    columns = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            r = F.round(F.round(F.col(f"`{f.name}`"), GUARD), DIGITS)
            columns[f.name] = F.when(r == 0, F.lit(0.0)).otherwise(r)
    return df.withColumns(columns) if columns else df


def r(expression: str) -> str:
    """The SQL twin of :func:`rounded` for one expression."""
    value = f"round(round(CAST({expression} AS DOUBLE), {GUARD}), {DIGITS})"
    return f"(CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END)"
