"""Spatial layout of stored layers: order, pushed filters, row groups read."""

import glob
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessarea.functions import morton
from tessarea.operators.maplayer import bbox_filter
from tessarea.session import scratch_path
from tessarea.sources import attributes, read_layer, write_layer

SIDE = 120


def squares(spark, side=SIDE):
    """Unit squares of a grid, in an order that has nothing to do with place."""
    x, y = F.col("id") % side, F.floor(F.col("id") / side)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    ring = F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in corners])
    return spark.range(side * side).orderBy(F.xxhash64("id")).select(F.col("id").alias("area"), F.array(ring).alias("rings"))


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "layout") + ".parquet"
    write_layer(squares(spark), path, by_place=True, group_rows=200)
    return path


def rows_scanned(df):
    """Rows that the scan handed on, after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_curve_interleaves_bits(spark):
    points = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.3, 0.8), (-5.0, 9.0), (None, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, x double, y double")
    got = {r.i: r.m for r in df.select("i", morton(F.col("x"), F.col("y"), 0.0, 0.0, 1.0, 1.0).alias("m")).collect()}

    def place(x, y):
        if x is None or y is None:
            return None
        cells = [math.floor(min(max(v, 0.0), 1.0) * (2**31 - 1)) for v in (x, y)]
        return sum((c >> k & 1) << (2 * k + axis) for axis, c in enumerate(cells) for k in range(31))

    assert got == {i: place(*p) for i, p in enumerate(points)}


def test_windows_equal_those_of_the_unstored_layer(spark, stored, rows):
    layer, plain = read_layer(spark, stored), squares(spark)
    for box in ((3.0, 4.0, 9.0, 5.0), (-9.0, -9.0, 0.0, 0.0), (500.0, 0.0, 600.0, 10.0), (0.0, 0.0, 999.0, 999.0)):
        assert rows(bbox_filter(layer, *box), "area") == rows(bbox_filter(plain, *box), "area")


def test_filter_reaches_the_scan_and_row_groups_are_skipped(spark, stored):
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(stored + "/*.parquet"))
    assert groups > 20
    window = bbox_filter(read_layer(spark, stored), 40.2, 40.2, 44.8, 44.8).select("area")
    scan = window._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    pushed = scan.metadata().apply("PushedFilters")
    assert "GreaterThanOrEqual(bbox.xmax,40.2)" in pushed and "LessThanOrEqual(bbox.ymin,44.8)" in pushed
    assert "rings" not in scan.metadata().apply("ReadSchema")
    assert window.count() == 25
    assert rows_scanned(window) < SIDE * SIDE / 8


def test_odd_geometry_and_equal_places(spark, rows):
    nan, inf = float("nan"), float("inf")
    shapes = [(1, [[(0.0, 0.0), (1.0, 1.0)]]), (2, []), (3, None), (4, [[(nan, 0.0)]]), (5, [[(inf, 2.0)]])]
    shapes += [(10 + i, [[(0.5, 0.5)]]) for i in range(50)]
    layer = spark.createDataFrame(shapes, "area int, rings array<array<struct<x:double,y:double>>>")
    path = scratch_path(spark, "odd") + ".parquet"
    write_layer(layer, path, by_place=True)
    back = read_layer(spark, path)
    assert rows(back, "area") == rows(layer, "area")
    assert attributes(back).columns == ["area"]
    assert rows(bbox_filter(back, 0.0, 0.0, 2.0, 2.0), "area") == rows(bbox_filter(layer, 0.0, 0.0, 2.0, 2.0), "area")


def test_empty_layer(spark):
    path = scratch_path(spark, "empty") + ".parquet"
    write_layer(squares(spark).limit(0), path, by_place=True)
    assert bbox_filter(read_layer(spark, path), 0.0, 0.0, 1.0, 1.0).count() == 0


def test_writing_a_stored_layer_again_keeps_one_envelope(spark, stored, rows):
    path = scratch_path(spark, "again") + ".parquet"
    write_layer(read_layer(spark, stored), path, by_place=True)
    assert read_layer(spark, path).columns == ["area", "rings", "bbox"]
    assert read_layer(spark, path).count() == SIDE * SIDE
