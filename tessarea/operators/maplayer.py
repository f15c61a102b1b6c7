"""Map-ready tables: joining statistics to geometry, aligning and auditing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import censored
from ..session import cut_lineage
from .graph import BBOX, envelope


def with_geometry(stats: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """Statistics with their polygons; areas in both tables only."""
    return stats.join(layer.select(key, "rings"), key)


def censor(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Values outside ``[lo, hi]`` become missing."""
    return df.withColumn(column, censored(F.col(column), lo, hi))


def bbox_filter(
    layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float
) -> DataFrame:
    """Areas whose envelope overlaps the box. Touching counts as overlap.

    A stored envelope (column ``bbox``) is used where the layer has one: the filter
    then reaches the scan, and row groups outside the box are not read.
    """
    stored = "bbox" in layer.columns
    left, bottom, right, top = [F.col(f"bbox.{c}") for c in BBOX] if stored else envelope()
    return layer.where(
        (right >= xmin) & (left <= xmax) & (top >= ymin) & (bottom <= ymax)
    )


def map_layer(
    stats: DataFrame,
    layer: DataFrame,
    key: str,
    measure: str,
    limits: tuple[float, float] | None = None,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """``key, measure, rings`` of a map, censored to a scale and cut to a window."""
    shapes = layer if box is None else bbox_filter(layer, *box)
    table = with_geometry(stats.select(key, measure), shapes, key)
    return table if limits is None else censor(table, measure, *limits)


def left_merge(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """All left rows; columns of the same name get a suffix."""
    return join_suffixed(left, right, [key], suffixes, how="left")


def join_suffixed(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    suffixes: tuple[str, str] = (".x", ".y"),
    how: str = "inner",
) -> DataFrame:
    """Join whose equally named non-key columns are told apart by suffixes."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(on), how)


def align_by_key(
    left: DataFrame, right: DataFrame, key: str, column: str, fill: float = 0.0
) -> DataFrame:
    """``left`` with ``column`` of ``right``; areas ``right`` lacks get ``fill``."""
    return left.join(right.select(key, column), key, "left").withColumn(
        column, F.coalesce(column, F.lit(fill))
    )


def key_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How the keys of two tables match: ``n_left_only, n_right_only, n_both``.

    Keys are reduced to one row each before they meet, so repeated keys do not
    multiply; a missing key counts as a key.
    """
    sides = (
        a.select(F.col(key).alias("_k"), F.lit(1).alias("_side"))
        .unionByName(b.select(F.col(key).alias("_k"), F.lit(2).alias("_side")))
        .groupBy("_k")
        .agg(F.bit_or("_side").alias("_sides"))
    )
    return sides.agg(
        F.count_if(F.col("_sides") == 1).alias("n_left_only"),
        F.count_if(F.col("_sides") == 2).alias("n_right_only"),
        F.count_if(F.col("_sides") == 3).alias("n_both"),
    )


def release_digest(table: DataFrame, key: str, columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Order-free digest of a release per bucket of keys: ``bucket, n_keys, n_rows, d0, ..., d3``.

    Made once per release and stored with it. Rows of one key count with their number,
    so a repeated row is told from a single one. The digests are sums of the four halves
    of two 64-bit hashes, exact as decimals; a difference is overlooked with a chance of 2**-128.
    """
    row = _row_hashes(key, columns)
    per_key = table.select(F.col(key).alias("_k"), *row).groupBy("_k").agg(*_hash_sums(), F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(_bucket("_k", buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("_n").alias("n_rows"), *_hash_sums()
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _row_hashes(key: str, columns: Sequence[str]) -> list[Column]:
    hashes = [F.xxhash64(F.lit(seed), key, *columns) for seed in (1, 2)]
    halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [h.cast("decimal(20,0)").alias(f"d{i}") for i, h in enumerate(halves)]


def _hash_sums() -> list[Column]:
    return [F.sum(f"d{i}").cast("decimal(38,0)").alias(f"d{i}") for i in range(4)]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose digests are not equal, or that one release lacks."""
    digest = F.struct("n_keys", "n_rows", "d0", "d1", "d2", "d3")
    both = a.select("bucket", digest.alias("_a")).join(b.select("bucket", digest.alias("_b")), "bucket", "full")
    return both.where(~F.equal_null("_a", "_b")).select("bucket")


def release_changes(
    a: DataFrame, b: DataFrame, digest_a: DataFrame, digest_b: DataFrame, key: str, columns: Sequence[str],
    buckets: int = 4096,
) -> DataFrame:
    """Keys that two releases differ in: ``key, change`` of ``added``, ``removed`` or ``changed``.

    Only rows of buckets whose digests differ are shuffled; the others stop at a filter in
    the scan's own stage. The list of buckets is at most ``buckets`` long. A missing key counts as a key.
    """
    wanted = cut_lineage(_differing(digest_a, digest_b), "buckets")

    def side(table: DataFrame, mark: int) -> DataFrame:
        rows = table.select(F.col(key).alias("_k"), *_row_hashes(key, columns)).withColumn("bucket", _bucket("_k", buckets))
        return rows.join(F.broadcast(wanted), "bucket", "left_semi").withColumn("_side", F.lit(mark))

    rows = side(a, 1).unionByName(side(b, 2))
    sides = []
    for mark in (1, 2):
        here = F.col("_side") == mark
        sums = [F.sum(F.when(here, F.col(f"d{i}"))).cast("decimal(38,0)") for i in range(4)]
        sides.append(F.struct(F.count_if(here).alias("n"), *[s.alias(f"d{i}") for i, s in enumerate(sums)]))
    met = rows.groupBy("_k").agg(sides[0].alias("_a"), sides[1].alias("_b"))
    change = (
        F.when(F.col("_a.n") == 0, "added").when(F.col("_b.n") == 0, "removed").when(F.col("_a") != F.col("_b"), "changed")
    )
    return met.select(F.col("_k").alias(key), change.alias("change")).where("change IS NOT NULL")


def release_audit(
    a: DataFrame, b: DataFrame, digest_a: DataFrame, digest_b: DataFrame, key: str, buckets: int = 4096
) -> DataFrame:
    """:func:`key_audit` of two releases by digests of their keys (made with no columns).

    Buckets that agree count by their stored number of keys and are not read.
    """
    changes = release_changes(a, b, digest_a, digest_b, key, [], buckets)
    keys = digest_a.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).scalar()
    return changes.agg(
        F.count_if(F.col("change") == "removed").alias("n_left_only"),
        F.count_if(F.col("change") == "added").alias("n_right_only"),
    ).withColumn("n_both", keys - F.col("n_left_only"))
