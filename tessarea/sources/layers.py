"""Geometry layers: attribute columns plus ``rings``, an array of rings of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import morton
from ..operators.graph import BBOX, envelope

RINGS = "array<array<struct<x:double,y:double>>>"


def read_layer(
    spark: SparkSession, path: str, properties: StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Scan a Parquet layer, or GeoJSON features and collections of them.

    For GeoJSON, ``properties`` is the schema of the attribute object. Each line is a
    feature or a whole FeatureCollection; with ``multi_line`` each file is one. Lines
    that are no JSON object raise, so a collection broken over lines is not misread.
    Polygon and MultiPolygon coordinates are both brought to one flat array of rings.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if properties is None:
        raise ValueError("a GeoJSON layer needs the schema of its properties")
    fields = (
        properties if isinstance(properties, StructType) else StructType.fromDDL(properties)
    )
    # Coordinates nest three deep for a Polygon, four for a MultiPolygon, so they
    # are taken as text first and decoded by geometry type.
    feature = StructType.fromDDL("geometry struct<type:string,coordinates:string>").add("properties", fields)
    schema = StructType([*feature.fields, StructField("features", ArrayType(feature))])
    read = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    alone = F.array(F.struct("geometry", "properties"))
    features = read.select(F.inline(F.coalesce("features", alone)))
    text = F.col("geometry.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    flat = F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    rings = F.transform(
        flat,
        lambda ring: F.transform(
            ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
        ),
    )
    return features.select("properties.*", rings.alias("rings"))


def write_layer(layer: DataFrame, path: str, by_place: bool = False, group_rows: int | None = None) -> None:
    """Write a layer as Parquet (``*.parquet``) or as line-delimited GeoJSON features.

    ``by_place`` lays Parquet out for windows of the map: areas are in the order of a
    space-filling curve through the centres of their envelopes, and the envelope is
    stored in the column ``bbox``, whose statistics let a scan skip row groups.
    ``group_rows`` is the most areas of a row group; the default leaves it to size.
    """
    if path.rstrip("/").endswith(".parquet"):
        writer = (along_curve(layer) if by_place else layer).write.mode("overwrite")
        if group_rows:
            writer = writer.option("parquet.block.row.count.limit", group_rows)
        writer.parquet(path)
        return
    coordinates = F.array(
        F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    )
    names = [c for c in layer.columns if c not in ("rings", "bbox")]
    layer.select(
        F.lit("Feature").alias("type"),
        F.struct(*names).alias("properties"),
        F.struct(
            F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")
        ).alias("geometry"),
    ).write.mode("overwrite").json(path)


def along_curve(layer: DataFrame) -> DataFrame:
    """The layer with ``bbox``, in ranges of a Z-order curve over its extent.

    The extent is one aggregated row. Areas at one place are told apart by a hash of
    their attributes, so that many of them do not make one range. Areas without a
    finite point have no place on the curve and come first.
    """
    xmin, ymin, xmax, ymax = envelope()
    corners = F.struct(*[c.alias(n) for c, n in zip((xmin, ymin, xmax, ymax), BBOX)])
    boxed = layer.drop("bbox").withColumn("bbox", corners)
    x, y = ((F.col("bbox")[lo] + F.col("bbox")[hi]) / 2 for lo, hi in (("xmin", "xmax"), ("ymin", "ymax")))

    def finite(c: Column) -> Column:
        return F.when(F.abs(c) < float("inf"), c)

    extent = boxed.agg(
        *[f(finite(c)).alias(n) for n, f, c in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))]
    ).first()
    place = morton(finite(x), finite(y), extent.x0, extent.y0, extent.x1, extent.y1)
    names = [f"`{c}`" for c in boxed.columns if c not in ("rings", "bbox")]
    tie = F.xxhash64(*names, "bbox")
    placed = boxed.withColumns({"_place": place, "_tie": tie})
    return placed.repartitionByRange("_place", "_tie").sortWithinPartitions("_place", "_tie").drop("_place", "_tie")


def attributes(layer: DataFrame) -> DataFrame:
    """The layer without geometry; on Parquet the ring column is never read."""
    return layer.drop("rings", "bbox")
