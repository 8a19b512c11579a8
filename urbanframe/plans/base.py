"""Building base layer: one row per building with footprint, height and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import height_category, round_numeric
from urbanframe.operators.dissolve import dissolve
from urbanframe.operators.footprints import footprint_chain
from urbanframe.operators.ids import dense_id


def building_base(
    feature: DataFrame, prop: DataFrame, objectclass: DataFrame, geometry_data: DataFrame,
    extended: bool = False,
) -> DataFrame:
    """Footprints dissolved per building; ``extended`` adds bounding-box measures.

    Geometries are expected in the metric CRS, so areas need no reprojection.
    """
    chain = footprint_chain(feature, prop, objectclass, geometry_data)
    keys = ["building_id", "building_gml_id", "ground_elevation", "roof_elevation", "building_height"]
    pieces = chain.where(G.not_empty("footprint_3d")).select(
        *keys, "geometry_id", G.polygons_only("footprint_3d").alias("geom")
    )
    layer = dissolve(pieces, keys, "geom", "geometry_id").where(~G.st_isempty("geom"))
    height = F.col("building_height")
    layer = layer.withColumn("bbox", G.st_bbox("geom"))
    cols = [
        F.col("building_id"), F.col("building_gml_id"),
        round_numeric("ground_elevation", 2).alias("ground_elevation_m"),
        round_numeric("roof_elevation", 2).alias("roof_elevation_m"),
        round_numeric(height, 2).alias("height_m"),
        height_category(height).alias("height_category"),
        round_numeric(G.st_area("geom"), 2).alias("footprint_area_m2"),
    ]
    if extended:
        box = F.col("bbox")
        cols += [
            round_numeric(G.bbox_area(box), 2).alias("bbox_area_m2"),
            round_numeric(G.bbox_min_width(box), 2).alias("min_face_width_m"),
        ]
    return dense_id(layer.select(*cols, "geom", "bbox"), ["building_id"], "gid")
