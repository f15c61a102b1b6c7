"""Polygon contiguity as an edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import LambertConic
from ..session import cut_lineage

# Side of the cells in which near points are looked for, as a multiple of the distance.
CELL = 64
# A point shared by more areas than this is treated apart. In a proper polygon
# coverage only a handful of areas meet at one point.
HOT_POINT = 256


def vertices(layer: DataFrame, key: str) -> DataFrame:
    """One row per polygon vertex: ``key, ring, pos, x, y`` (ring and pos from 0)."""
    rings = layer.select(key, F.posexplode("rings").alias("ring", "_points"))
    points = rings.select(key, "ring", F.posexplode("_points").alias("pos", "_p"))
    return points.select(key, "ring", "pos", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def project_lcc(points: DataFrame, projection: LambertConic, lon: str = "x", lat: str = "y") -> DataFrame:
    """Points with ``easting`` and ``northing`` in metres added."""
    easting, northing = projection.project(F.col(lon), F.col(lat))
    return points.withColumns({"easting": easting, "northing": northing})


# Fields of a stored envelope, the struct column ``bbox``.
BBOX = ("xmin", "ymin", "xmax", "ymax")


def envelope(rings: str = "rings") -> tuple[Column, Column, Column, Column]:
    """``xmin, ymin, xmax, ymax`` of a polygon column, without explode or shuffle."""
    points = F.flatten(rings)
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _pairs(members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Ordered pairs ``a < b`` of areas that agree on ``on``."""
    left = members.select(F.col("_area").alias("a"), *on)
    right = members.select(F.col("_area").alias("b"), *on)
    return left.join(right, list(on)).where("a < b")


def contiguity(
    layer: DataFrame,
    key: str,
    queen: bool = False,
    snap: float = 1.5e-8,
    by: Sequence[str] = (),
    hot_point: int = HOT_POINT,
) -> DataFrame:
    """Directed neighbour pairs ``by..., src, dst`` (both directions).

    Rook (the default) asks for at least two shared boundary points, queen for
    one. Two points are shared if they are at most ``snap`` apart; under rook each
    area must have two points with a partner in the other. ``by`` (e.g. the level)
    keeps several layers apart in one job.

    Equal points meet by an equi-join. Points that differ, but by no more than
    ``snap``, are looked for among the distinct points by cells: each goes to the
    cells within reach, then distances are compared. Where there are such points,
    the pairs of areas that meet there are counted again with both kinds.

    Points shared by many areas are kept out of the vertex self-join under rook,
    as nearly all pairs it would emit there are no neighbours. They are met by
    two exact joins instead: pairs that agree on two such points, and pairs that
    share one ordinary point and have such a point in common. The vertex table
    and the (normally empty) table of such points are written to the shared
    folder: the same plan serves every layer, and its joins end at once where
    there are no such points.
    """
    by = list(by)
    point = [*by, "_px", "_py"]
    members = (
        layer.select(F.col(key).alias("_area"), *by, F.explode(F.flatten("rings")).alias("_p"))
        # Adding zero makes one of both zeros.
        .select("_area", *by, (F.col("_p.x") + F.lit(0.0)).alias("_px"), (F.col("_p.y") + F.lit(0.0)).alias("_py"))
        .distinct()
    )
    members = cut_lineage(members, "vertices")
    near = cut_lineage(_near_points(members, by, snap), "near-points")
    exact = _queen(members, by) if queen else _rook(members, by, hot_point)
    if not near.isEmpty():
        exact = exact.unionByName(_near_pairs(members, near, by, queen)).distinct()
    return _both_ways(exact, by)


def _near_points(members: DataFrame, by: Sequence[str], snap: float) -> DataFrame:
    """Ordered pairs ``by..., _px, _py, _qx, _qy`` of different points at most ``snap`` apart."""
    cell = F.lit(snap * CELL)
    points = members.select(*by, "_px", "_py").distinct()

    def reached(c: str):
        low, high = F.floor((F.col(c) - snap) / cell), F.floor((F.col(c) + snap) / cell)
        return F.explode(F.sequence(low, high))

    # A point is sought in its own cell and offered in all cells within reach: each pair once.
    sought = points.withColumns({"_cx": F.floor(F.col("_px") / cell), "_cy": F.floor(F.col("_py") / cell)})
    offered = points.select(*by, F.col("_px").alias("_qx"), F.col("_py").alias("_qy"))
    offered = offered.withColumn("_cx", reached("_qx")).withColumn("_cy", reached("_qy"))
    dx, dy = F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy")
    square = dx * dx + dy * dy
    return (
        sought.join(offered, [*by, "_cx", "_cy"])
        .where((square <= snap * snap) & (square > 0))
        .select(*by, "_px", "_py", "_qx", "_qy")
    )


def _near_pairs(members: DataFrame, near: DataFrame, by: Sequence[str], queen: bool) -> DataFrame:
    """Pairs ``by..., a, b`` of neighbours among the areas that have near points of each other."""
    own = members.select(*by, F.col("_area").alias("a"), "_px", "_py")
    other = members.select(*by, F.col("_area").alias("b"), F.col("_px").alias("_qx"), F.col("_py").alias("_qy"))
    met = own.join(near, [*by, "_px", "_py"]).join(other, [*by, "_qx", "_qy"]).where("a <> b")
    met = cut_lineage(met.select(*by, "a", "b", "_px", "_py").distinct(), "near-pairs")
    pairs = met.select(*by, "a", "b").distinct()
    if queen:
        return pairs.where("a < b")
    # The equal points that these areas share as well.
    equal = (
        pairs.join(own, [*by, "a"])
        .join(other.withColumnsRenamed({"_qx": "_px", "_qy": "_py"}), [*by, "b", "_px", "_py"])
        .select(*by, "a", "b", "_px", "_py")
    )
    counts = met.unionByName(equal).distinct().groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    enough = counts.where("_n >= 2").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return enough.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def _queen(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every pair that meets at a point is a result; repeats collapse map-side."""
    return _pairs(members, [*by, "_px", "_py"]).select(*by, "a", "b").distinct()


def _rook(members: DataFrame, by: Sequence[str], hot_point: int) -> DataFrame:
    """Pairs that agree on two points at least."""
    point = [*by, "_px", "_py"]
    crowds = members.groupBy(*point).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(crowds.where(F.col("_n") > hot_point).select(*point), "hot-points")
    shared = (
        _pairs(members.join(hot, point, "left_anti"), point)
        .groupBy(*by, "a", "b")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    plain = shared.where("_n >= 2").select(*by, "a", "b")
    sets = (
        members.join(hot, point, "left_semi")
        .groupBy(*by, "_area")
        .agg(F.array_sort(F.collect_set(F.struct("_px", "_py"))).alias("_points"))
    )
    # Two hot points of one area, so that agreeing rows are neighbours already.
    doubles = sets.select(
        "_area", *by, F.posexplode("_points").alias("_i", "_first"), "_points"
    ).select(
        "_area",
        *by,
        "_first",
        F.explode(F.slice("_points", F.col("_i") + 2, F.size("_points"))).alias("_second"),
    )
    both_hot = _pairs(doubles, [*by, "_first", "_second"]).select(*by, "a", "b")
    one_each = (
        shared.where("_n = 1")
        .join(sets.select(*by, F.col("_area").alias("a"), F.col("_points").alias("_pa")), [*by, "a"])
        .join(sets.select(*by, F.col("_area").alias("b"), F.col("_points").alias("_pb")), [*by, "b"])
        .where(F.arrays_overlap("_pa", "_pb"))
        .select(*by, "a", "b")
    )
    return plain.unionByName(both_hot).unionByName(one_each).distinct()


def _both_ways(undirected: DataFrame, by: Sequence[str]) -> DataFrame:
    directions = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return undirected.select(*by, F.inline(directions))


def weights(edges: DataFrame) -> DataFrame:
    """Binary weights: 1 for every directed neighbour pair."""
    return edges.withColumn("w", F.lit(1.0))


def degree(areas: DataFrame, edges: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of neighbours of every area, 0 for islands: ``by..., key, n_neighbours``."""
    counts = (
        edges.groupBy(*by, F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("n_neighbours"))
    )
    return (
        areas.select(*by, key)
        .join(counts, [*by, key], "left")
        .withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0)))
    )


def edges_between(areas: DataFrame, edges: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Edges ``by..., src, dst`` whose ends both have a row in ``areas(by..., key)``."""
    kept = edges.select(*by, "src", "dst")
    for end in ("src", "dst"):
        rows = areas.select(*by, F.col(key).alias(end))
        kept = kept.join(rows, [*by, end], "left_semi")
    return kept


def _linked(areas: DataFrame, edges: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Areas with an edge to another area of the table, one row each, reduced map-side."""
    other = areas.select(*by, F.col(key).alias("dst"))
    return (
        edges.select(*by, "src", "dst")
        .join(other, [*by, "dst"], "left_semi")
        .select(*by, F.col("src").alias(key))
        .distinct()
    )


def islands(areas: DataFrame, edges: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Areas without a neighbour among the areas."""
    return areas.join(_linked(areas, edges, key, by), [*by, key], "left_anti")


def drop_islands(areas: DataFrame, edges: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Areas that have a neighbour among the areas.

    The weights and the data must lose the same areas, or they no longer match.
    """
    return areas.join(_linked(areas, edges, key, by), [*by, key], "left_semi")
