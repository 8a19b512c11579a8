"""Estimated built density (floor area over parcel area)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import count_if, estimated_floors, round_numeric, safe_ratio
from urbanframe.operators.ids import dense_id

# Fixed texts of the published layers.
QUESTION_ESTIMATE = "¿Cuánta superficie construida estimada aporta este edificio dentro de su parcela?"
QUESTION_FAR = "¿Qué parcelas tienen mayor densidad construida estimada?"


def building_far_estimate(pieces: DataFrame) -> DataFrame:
    """Floors, floor area and share of the parcel per overlay piece."""
    floors = estimated_floors(F.col("height_m"))
    floor_area = F.col("intersection_area_m2") * floors
    rows = pieces.where(F.col("intersection_area_m2") > 0).select(
        F.col("gid").alias("building_gid"), "building_id", "building_gml_id", "parcel_id", "height_m",
        "height_category", "footprint_area_m2", "parcel_area_m2", "intersection_area_m2",
        floors.alias("estimated_floors"), round_numeric(floor_area, 2).alias("estimated_floor_area_m2"),
        round_numeric(safe_ratio(floor_area, F.col("parcel_area_m2")), 3).alias("building_far_contribution"),
        F.lit(QUESTION_ESTIMATE).alias("question"), "geom",
    )
    return dense_id(rows, ["parcel_id", "building_gid"], "id", settled=True)


def parcel_far_agg(estimates: DataFrame) -> DataFrame:
    """Sums and extremes per parcel; overlapping pieces add up on purpose."""
    return estimates.groupBy("parcel_id").agg(
        F.countDistinct("building_gml_id").alias("buildings_count"),
        F.sum("intersection_area_m2").alias("occupied_area_m2"),
        F.sum("estimated_floor_area_m2").alias("estimated_floor_area_m2"),
        F.max("height_m").alias("max_building_height_m"), F.avg("height_m").alias("avg_building_height_m"),
        F.max("estimated_floors").alias("max_estimated_floors"), F.avg("estimated_floors").alias("avg_estimated_floors"),
    )


def parcel_far(parcels: DataFrame, estimates: DataFrame) -> DataFrame:
    area = F.col("_area")

    def or_zero(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    floor_area = or_zero("estimated_floor_area_m2")
    ratio = safe_ratio(floor_area, area)
    level = F.when(ratio >= 3.0, "HIGH").when(ratio >= 1.5, "MEDIUM").when(floor_area > 0, "LOW").otherwise("EMPTY")
    rows = (
        parcels.withColumn("_area", G.st_area("geom")).join(parcel_far_agg(estimates), "parcel_id", "left")
        .select(
            "parcel_id", F.coalesce("buildings_count", F.lit(0)).cast("long").alias("buildings_count"),
            round_numeric(area, 2).alias("parcel_area_m2"),
            round_numeric(or_zero("occupied_area_m2"), 2).alias("occupied_area_m2"),
            round_numeric(floor_area, 2).alias("estimated_floor_area_m2"), round_numeric(ratio, 3).alias("far_ratio"),
            round_numeric(or_zero("max_building_height_m"), 2).alias("max_building_height_m"),
            round_numeric(or_zero("avg_building_height_m"), 2).alias("avg_building_height_m"),
            F.coalesce("max_estimated_floors", F.lit(0)).cast("int").alias("max_estimated_floors"),
            round_numeric(or_zero("avg_estimated_floors"), 2).alias("avg_estimated_floors"),
            level.alias("far_level"), F.lit(QUESTION_FAR).alias("question"), "geom",
        )
    )
    return dense_id(rows, ["parcel_id"], "gid")


def far_summary(layer: DataFrame) -> DataFrame:
    def level(v):
        return count_if(F.col("far_level") == v)

    return layer.agg(
        F.count(F.lit(1)).alias("total_parcels"),
        level("HIGH").alias("high_far_parcels"), level("MEDIUM").alias("medium_far_parcels"),
        level("LOW").alias("low_far_parcels"), level("EMPTY").alias("empty_parcels"),
        round_numeric(F.avg("far_ratio"), 3).alias("avg_far_ratio"), round_numeric(F.min("far_ratio"), 3).alias("min_far_ratio"),
        round_numeric(F.max("far_ratio"), 3).alias("max_far_ratio"),
        round_numeric(F.avg("parcel_area_m2"), 2).alias("avg_parcel_area_m2"),
        round_numeric(F.avg("estimated_floor_area_m2"), 2).alias("avg_estimated_floor_area_m2"),
        round_numeric(F.avg("max_building_height_m"), 2).alias("avg_max_building_height_m"),
    )
