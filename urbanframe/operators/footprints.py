"""From store rows to building footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.session import any_size


def features_of_class(feature: DataFrame, objectclass: DataFrame, classname: str) -> DataFrame:
    """Features of one class. Spark broadcasts the class dictionary if its size allows."""
    ids = objectclass.where(F.col("classname") == classname).select(F.col("id").alias("objectclass_id"))
    return feature.join(ids, "objectclass_id", "left_semi")


def footprint_chain(
    feature: DataFrame, prop: DataFrame, objectclass: DataFrame, geometry_data: DataFrame
) -> DataFrame:
    """One row per ground-surface geometry of a building.

    building > boundary property > ground surface > geometry property > geometry
    """
    b = features_of_class(feature, objectclass, "Building").select(
        F.col("id").alias("building_id"), F.col("objectid").alias("building_gml_id"),
        G.st_bbox("envelope").alias("envelope_bbox"),
    )
    bound = prop.where((F.col("name") == "boundary") & F.col("val_feature_id").isNotNull()).select(
        F.col("feature_id").alias("building_id"), F.col("val_feature_id").alias("surface_id")
    )
    ground = features_of_class(feature, objectclass, "GroundSurface").select(F.col("id").alias("surface_id"))
    owns = prop.where(F.col("val_geometry_id").isNotNull()).select(
        F.col("feature_id").alias("surface_id"), F.col("val_geometry_id").alias("geometry_id")
    )
    shapes = geometry_data.select(F.col("id").alias("geometry_id"), F.col("geometry").alias("footprint_3d"))
    return (
        b.join(any_size(bound), "building_id")
        .join(any_size(ground), "surface_id")
        .join(any_size(owns), "surface_id")
        .join(any_size(shapes), "geometry_id")
        .select(
            "building_id", "building_gml_id", "surface_id", "geometry_id", "envelope_bbox",
            F.col("envelope_bbox.zmin").alias("ground_elevation"),
            F.col("envelope_bbox.zmax").alias("roof_elevation"),
            G.bbox_height(F.col("envelope_bbox")).alias("building_height"),
            "footprint_3d",
        )
    )
