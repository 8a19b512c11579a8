"""Parcel occupation: how much of each parcel buildings cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions.scalars import count_if, graded, round_numeric, safe_ratio
from urbanframe.operators.dissolve import covered_area
from urbanframe.operators.ids import dense_id, rank_in_group
from urbanframe.operators.spatial_join import bbox_join
from urbanframe.session import cut_lineage

MODEL_MARGIN_M = 100.0
COVERAGE_STEPS = [(0.60, "HIGH"), (0.40, "MEDIUM")]

# Fixed texts of the published layers.
QUESTION_PIECES = "¿Qué parte de cada parcela es ocupada por la huella de cada edificio?"
QUESTION_COVERAGE = "¿Qué porcentaje de la parcela ocupa cada edificio?"
QUESTION_FOS = "¿Qué porcentaje de la parcela está ocupado por edificios?"


def _clean(geom: str):
    return K.st_unaryunion(G.polygons_only(geom))


def buildings_clean(base: DataFrame) -> DataFrame:
    """Non-empty footprints, valid and dissolved."""
    return base.where(G.not_empty("geom")).select(
        "gid", "building_id", "building_gml_id", "height_m", "height_category", "footprint_area_m2",
        _clean("geom").alias("geom"), "bbox",
    )


def parcels_clean(parcels: DataFrame, buildings: DataFrame, margin: float = MODEL_MARGIN_M) -> DataFrame:
    """Parcels within the margin of the envelope of all buildings.

    The envelope is one row, read as a scalar subquery; the bounding-box test
    drops far parcels before the exact distance.
    """
    area = buildings.select(G.extent_agg(F.col("bbox"))).scalar()
    near = (
        parcels.where(G.not_empty("geom"))
        .withColumn("_area", area)
        .where(G.bbox_distance(F.col("bbox"), F.col("_area")) <= margin)
    )
    frame = G.st_rectangle(
        F.col("_area.xmin"), F.col("_area.ymin"), F.col("_area.xmax"), F.col("_area.ymax"), srid=F.col("geom.srid")
    )
    return near.where(K.st_dwithin(F.col("geom"), frame, margin)).select(
        F.col("id").cast("string").alias("parcel_id"), _clean("geom").alias("geom"), "bbox"
    )


def building_parcel_intersections(buildings: DataFrame, parcels: DataFrame) -> DataFrame:
    """Overlay pieces with areas, share of the parcel and rank per building."""
    p = parcels.select("parcel_id", F.col("geom").alias("_pgeom"), F.col("bbox").alias("_pbox"))
    b = buildings.withColumnRenamed("geom", "_bgeom").withColumnRenamed("bbox", "_bbox")
    pieces = (
        bbox_join(b, p, "_bbox", "_pbox")
        .withColumn("geom", K.st_intersection("_bgeom", "_pgeom"))
        .withColumn("_area", G.st_area("geom"))
        .where(F.col("_area") > 0)
        .withColumn("_parcel", G.st_area("_pgeom"))
        .drop("_bgeom", "_pgeom", "_bbox", "_pbox")
    )
    ranked = rank_in_group(pieces, "gid", [F.desc("_area"), F.asc("parcel_id")], "parcel_rank")
    rows = ranked.select(
        "gid", "building_id", "building_gml_id", "parcel_id", "height_m", "height_category",
        round_numeric("footprint_area_m2", 2).alias("footprint_area_m2"),
        round_numeric("_parcel", 2).alias("parcel_area_m2"),
        round_numeric("_area", 2).alias("intersection_area_m2"),
        round_numeric(safe_ratio(F.col("_area"), F.col("_parcel")) * 100, 2).alias("intersection_coverage_pct"),
        "parcel_rank", F.lit(QUESTION_PIECES).alias("question"), "geom",
    )
    return dense_id(rows, ["gid", "parcel_id"], "id", settled=True)


def building_parcel_coverage(pieces: DataFrame) -> DataFrame:
    """Main parcel of every building, levels on the rounded areas."""
    ratio = safe_ratio(F.col("intersection_area_m2"), F.col("parcel_area_m2"))
    return pieces.where(F.col("parcel_rank") == 1).select(
        "gid", "building_id", "building_gml_id", "parcel_id", "height_m", "height_category",
        "footprint_area_m2", "parcel_area_m2", "intersection_area_m2",
        round_numeric(ratio * 100, 2).alias("building_parcel_coverage_pct"),
        graded(ratio, COVERAGE_STEPS, "LOW").alias("coverage_level"),
        F.lit(QUESTION_COVERAGE).alias("question"), "geom",
    )


def parcel_fos(parcels: DataFrame, pieces: DataFrame) -> DataFrame:
    """Occupied share per parcel, overlapping pieces counted once, empty parcels kept."""
    measures = pieces.groupBy("parcel_id").agg(
        F.countDistinct("building_gml_id").alias("_n"), F.max("parcel_area_m2").alias("_cap"),
        F.max("height_m").alias("_max_h"), F.avg("height_m").alias("_avg_h"),
    )
    union = covered_area(pieces, ["parcel_id"], "geom")
    cover = measures.join(union, "parcel_id").withColumn("_occ", F.least("_cap", "covered_area"))
    area = F.col("_area")
    occ = F.coalesce(F.col("_occ"), F.lit(0.0))
    ratio = safe_ratio(occ, area)
    level = F.when(ratio > 0.60, "HIGH").when(ratio > 0.40, "MEDIUM").when(occ > 0, "LOW").otherwise("EMPTY")
    rows = (
        parcels.withColumn("_area", G.st_area("geom")).join(cover, "parcel_id", "left")
        .select(
            "parcel_id", F.coalesce("_n", F.lit(0)).cast("long").alias("buildings_count"),
            round_numeric(area, 2).alias("parcel_area_m2"), round_numeric(occ, 2).alias("occupied_area_m2"),
            round_numeric(F.least(F.lit(100.0), ratio * 100), 2).alias("fos_pct"),
            round_numeric(F.coalesce("_max_h", F.lit(0.0)), 2).alias("max_building_height_m"),
            round_numeric(F.coalesce("_avg_h", F.lit(0.0)), 2).alias("avg_building_height_m"),
            level.alias("fos_level"), F.lit(QUESTION_FOS).alias("question"), "geom",
        )
    )
    return dense_id(rows, ["parcel_id"], "gid")


def occupation_layers(base: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean parcels (written once, they feed several layers) and overlay pieces."""
    clean = buildings_clean(base)
    near = cut_lineage(parcels_clean(parcels, clean))
    return near, building_parcel_intersections(clean, near)


def fos_summary(layer: DataFrame) -> DataFrame:
    def level(v):
        return count_if(F.col("fos_level") == v)

    return layer.agg(
        F.count(F.lit(1)).alias("total_parcels"),
        level("HIGH").alias("high_fos_parcels"), level("MEDIUM").alias("medium_fos_parcels"),
        level("LOW").alias("low_fos_parcels"), level("EMPTY").alias("empty_parcels"),
        round_numeric(F.avg("fos_pct"), 2).alias("avg_fos_pct"), round_numeric(F.min("fos_pct"), 2).alias("min_fos_pct"),
        round_numeric(F.max("fos_pct"), 2).alias("max_fos_pct"),
        round_numeric(F.avg("parcel_area_m2"), 2).alias("avg_parcel_area_m2"),
        round_numeric(F.avg("occupied_area_m2"), 2).alias("avg_occupied_area_m2"),
    )


def impossible_fos(layer: DataFrame) -> DataFrame:
    """Control: parcels above 100 percent (none expected)."""
    return layer.where(F.col("fos_pct") > 100).select(
        "parcel_id", "parcel_area_m2", "occupied_area_m2", "fos_pct", "buildings_count"
    )
