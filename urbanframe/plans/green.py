"""Tall buildings near green space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions.scalars import height_category, round_numeric
from urbanframe.operators.ids import dense_id
from urbanframe.operators.spatial_join import nearest, semi_dwithin_points
from urbanframe.session import any_size, cut_lineage

GREEN_RADIUS_M = 500.0
TALL_M = 25.0
NEAR_M = 100.0


def building_height_points(geometries: DataFrame) -> DataFrame:
    """One point (bounding-box centre) and height per building geometry."""
    b = geometries.where(F.col("class") == "Building").withColumn("_box", G.st_bbox("geom"))
    height = G.bbox_height(F.col("_box"))
    point = G.bbox_center(F.col("_box"), F.col("geom.srid"))
    rows = b.select(
        F.col("id").alias("source_id"), F.col("class").alias("object_class"),
        round_numeric(height, 2).alias("height_m"), height_category(height).alias("height_category"),
        point.alias("geom"),
    )
    rows = rows.withColumn("bbox", G.st_bbox("geom"))
    return dense_id(rows, ["source_id"], "gid")


def green_near_model(greens: DataFrame, points: DataFrame, radius: float = GREEN_RADIUS_M) -> DataFrame:
    """Distinct cleaned green areas with a building within the radius."""
    pts = points.select(F.col("bbox.xmin").alias("px"), F.col("bbox.ymin").alias("py"))
    near = semi_dwithin_points(greens, "id", "geom", "bbox", pts, "px", "py", radius)
    clean = near.select("id", K.st_makevalid(G.polygons_only("geom")).alias("geom"), "bbox")
    return clean.dropDuplicates(["id", "geom"])


def buildings_near_green(points: DataFrame, greens_near: DataFrame) -> DataFrame:
    """Nearest green area and rounded distance per building."""
    greens_near = cut_lineage(greens_near)
    near = nearest(
        points.select("gid", "geom", "bbox"),
        greens_near.select(F.col("id").alias("green_id"), F.col("geom").alias("green_geom"), F.col("bbox").alias("green_bbox")),
        "gid", "green_id", "geom", "green_geom", "bbox", "green_bbox",
    )
    return points.join(any_size(near), "gid").select(
        "gid", "source_id", "object_class", "height_m", "height_category", "green_id",
        round_numeric("distance_m", 2).alias("distance_to_green_m"), "geom",
    )


def tall_near_green(layer: DataFrame) -> DataFrame:
    """Tall and close, judged on the rounded values."""
    return layer.where((F.col("height_m") >= TALL_M) & (F.col("distance_to_green_m") <= NEAR_M))


def high_buildings_near_green(geometries: DataFrame, greens: DataFrame) -> DataFrame:
    points = building_height_points(geometries)
    return tall_near_green(buildings_near_green(points, green_near_model(greens, points)))


def _stats(col: str, fns=("avg", "min", "max")):
    pick = {"avg": F.avg, "min": F.min, "max": F.max}
    return [round_numeric(pick[f](col), 2).alias(f"{f}_{col}") for f in fns]


def tall_green_summary(layer: DataFrame) -> DataFrame:
    return layer.agg(
        F.count(F.lit(1)).alias("high_buildings_near_green"), *_stats("height_m"), *_stats("distance_to_green_m")
    )


def tall_green_by_category(layer: DataFrame) -> DataFrame:
    return (
        layer.groupBy("height_category")
        .agg(F.count(F.lit(1)).alias("buildings"), *_stats("height_m", ("avg",)), *_stats("distance_to_green_m", ("avg",)))
        .orderBy(F.desc("avg_height_m"))
    )
