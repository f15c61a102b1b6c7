"""Exact quantiles and positions of groups of any size.

A group is never gathered or sorted in one task. Its range of values is cut into
equal cells that are counted map-side; the cells that hold the wanted ranks are cut
again, until they are small, and only what lies in those is ordered. Every pass
reads a stored copy of the two columns it needs, and returns a bounded number of
counts per group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import is_present
from ..session import cut_lineage

# Cells per range and pass, and the size of a cell that is ordered by value.
CELLS = 256
SMALL = 4096


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return df.join(stats, list(by))
    return df.withColumn("_s", stats.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """Number of the cell of a value; rises with the value, infinite ones have their own."""
    quarter = F.lit(0.25)  # the width of the range stays finite
    share = (v * quarter - low * quarter) / F.nullif(high * quarter - low * quarter, F.lit(0.0))
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells).cast("int"), F.lit(cells - 1))
    return (
        F.when(v == float("-inf"), -1).when(v == float("inf"), cells).otherwise(F.greatest(inside, F.lit(0)))
    )


def _narrowed(rows: DataFrame, wanted: DataFrame, by: Sequence[str], cells: int | None) -> DataFrame:
    """Wanted ranks with the cell of their range that holds them; ``cells`` None: one per value."""
    ranges = wanted.groupBy(*by).agg(F.collect_set(F.struct("_lo", "_hi", "_flo", "_fhi")).alias("_ranges"))
    if by:
        ranges = cut_lineage(ranges, "ranges")
    v = F.col("_v")
    # Ranges are apart or equal: a value lies in one at most.
    at = _attach(rows, ranges, by).select(
        *by, "_v", F.inline(F.filter("_ranges", lambda r: v.between(r["_lo"], r["_hi"])))
    )
    cell = v if cells is None else _cell(v, F.col("_flo"), F.col("_fhi"), cells)
    counted = (
        at.withColumn("_cell", cell)
        .groupBy(*by, "_lo", "_hi", "_cell")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.min(_finite(v)).alias("_fmin"),
            F.max(_finite(v)).alias("_fmax"),
        )
    )
    order = W.partitionBy(*by, "_lo", "_hi").orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = counted.withColumn("_end", F.sum("_c").over(order))
    key = [*by, "_lo", "_hi"]
    met = wanted.join(ends, key).where(
        (F.col("_rank") < F.col("_below") + F.col("_end"))
        & (F.col("_rank") >= F.col("_below") + F.col("_end") - F.col("_c"))
    )
    return met.select(
        *by,
        "_t",
        "_rank",
        F.col("_min").alias("_lo"),
        F.col("_max").alias("_hi"),
        F.col("_fmin").alias("_flo"),
        F.col("_fmax").alias("_fhi"),
        (F.col("_below") + F.col("_end") - F.col("_c")).alias("_below"),
        F.col("_c").alias("_n"),
    )


def _ranked(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    positions: Sequence[Callable[[Column], Column]],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per group: ``n``, the exact values at (fractional) 0-based positions, and ``extra``."""
    by = list(by)
    rows = cut_lineage(
        df.where(is_present(F.col(value))).select(*by, F.col(value).cast("double").alias("_v")), "values"
    )
    stats = cut_lineage(
        rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.min(_finite(F.col("_v"))).alias("_flo"),
            F.max(_finite(F.col("_v"))).alias("_fhi"),
            *extra,
        ),
        "ranges",
    )
    ranks = [
        F.struct(F.lit(2 * i + j).alias("_t"), edge(position(F.col("n"))).cast("bigint").alias("_rank"))
        for i, position in enumerate(positions)
        for j, edge in enumerate((F.floor, F.ceil))
    ]
    wanted = stats.where("n > 0").select(
        *by, F.inline(F.array(*ranks)), "_lo", "_hi", "_flo", "_fhi", F.lit(0).cast("bigint").alias("_below"),
        F.col("n").alias("_n"),
    )
    wanted = cut_lineage(wanted, "wanted")
    while (wanted.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0) > SMALL:
        wanted = cut_lineage(_narrowed(rows, wanted, by, CELLS), "wanted")
    found = _narrowed(rows, wanted, by, None).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_t", "_lo"))).alias("_found")
    )
    named = [c for c in stats.columns if c not in ("_lo", "_hi", "_flo", "_fhi")]
    if by:
        joined = stats.select(*named).join(found, by, "left")
    else:
        joined = stats.select(*named).withColumn("_found", found.select("_found").scalar())
    values = []
    for i, position in enumerate(positions):
        at = position(F.col("n"))
        share = at - F.floor(at)
        lo, hi = F.col("_found")[2 * i], F.col("_found")[2 * i + 1]
        values.append(F.when(share == 0, lo).otherwise(lo + (hi - lo) * share))
    return joined.withColumn("values", F.when(F.col("n") > 0, F.array(*values))).drop("_found")


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Exact quantiles, linear interpolation at ``(n - 1) * p``; ``by..., n, values``.

    Missing values are ignored. Without rows ``n`` is 0 and values are NULL.
    ``extra`` are aggregates over the present values ``_v``, from the same pass.
    """

    def at(p: float) -> Callable[[Column], Column]:
        def position(n: Column) -> Column:
            exact = (n - 1) * F.lit(float(p))
            # 0.2 and the like are not exact in binary: do not miss a whole rank.
            return F.when(F.abs(exact - F.rint(exact)) < 1e-9, F.rint(exact)).otherwise(exact)

        return position

    return _ranked(df, value, by, [at(p) for p in probs], extra)


def keys_at(df: DataFrame, key: str, ranks: Sequence[int]) -> list:
    """The keys at the given ranks (from 1) among those present; None beyond the last.

    Works for keys of any type that can be ordered, in that type. The keys are
    range-partitioned, and only the partitions that hold the ranks are numbered.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    parted = cut_lineage(
        keys.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()), "keys"
    )
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    starts = sizes.withColumn(
        "_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("_start") < rank) & (F.col("_start") + F.col("_n") >= rank))
    place = F.row_number().over(W.partitionBy("_part").orderBy("_k")) + F.col("_start")
    numbered = parted.join(starts.where(hit), "_part").select("_k", place.alias("_rank"))
    found = {r["_rank"]: r["_k"] for r in numbered.where(F.col("_rank").isin(list(ranks))).collect()}
    return [found.get(rank) for rank in ranks]
