"""Fit artefacts, partitioned by areal level and model variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fit(fit: DataFrame, path: str) -> None:
    """Write fits with ``level`` and ``variant`` as partition folders.

    Only the levels and variants in ``fit`` are replaced; others at the path stay, so
    fits can be saved one by one.

    One level or variant may hold most rows: no shuffle gathers a partition into
    one task, every task writes its own files.
    """
    fit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "variant").parquet(path)


def read_fit(spark: SparkSession, path: str, level: str, variant: str) -> DataFrame:
    """Read one fit; the filter prunes to one folder."""
    return spark.read.parquet(path).where(
        (F.col("level") == level) & (F.col("variant") == variant)
    )
