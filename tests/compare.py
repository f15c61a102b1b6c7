"""Run a query in Spark and its SQL twin in DuckDB, and compare the results."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, sorted; NaN and NaT become None."""
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False, name=None):
        rows.append(
            tuple(
                None
                if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v))
                else (v.item() if hasattr(v, "item") else v)
                for v in row
            )
        )
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(spark_df, con, sql: str) -> str | None:
    """None if both agree in columns, types and values."""
    relation = con.execute(sql)
    types = {d[0]: str(d[1]) for d in relation.description}
    want = relation.fetch_df() if hasattr(relation, "fetch_df") else relation.df()
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    if set(types) != set(spark_types):
        return f"columns {sorted(spark_types)} against {sorted(types)}"
    odd = {c: (spark_types[c], types[c]) for c in types if KIND.get(spark_types[c]) != types[c]}
    got = spark_df.toPandas()
    if odd:
        return f"types {odd}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return None
