"""Table scans and text sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ","
) -> DataFrame:
    """Scan a Parquet or delimited table.

    Delimited files need a schema, so that no extra pass is spent on guessing it.
    """
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a delimited table needs an explicit schema")
    return spark.read.schema(schema).csv(
        path, header=True, sep=sep, nanValue="NaN", nullValue="NA", enforceSchema=False
    )


def write_text_table(df: DataFrame, path: str, sep: str = " ") -> None:
    """Write a delimited table with a header; missing values are written as NA."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="NA")


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """A small table stated in the program."""
    return spark.createDataFrame(list(rows), schema)
