"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges run from the larger node ``u`` to the smaller ``v``.

    The minima are stored before they are joined back: a node with very many
    neighbours can then be split by adaptive execution.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star")
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u > v").distinct()


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    digest = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.shiftright(digest, 20)), F.sum(F.shiftrightunsigned(digest, 44))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that has a smaller node in its component.

    ``root`` is the smallest node of the component, which has no row itself.
    Nodes are any orderable type. Each step is stored in the shared folder, so
    a lost executor costs one step. Stops when a round changes nothing.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = _print(current)
    while mark[0]:
        current = cut_lineage(_stars(cut_lineage(_stars(current, True), "large"), False), "small")
        now = _print(current)
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
