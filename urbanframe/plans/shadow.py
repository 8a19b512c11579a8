"""Shadow cast on green space at one fixed sun position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions.scalars import count_if, graded, round_numeric, safe_ratio
from urbanframe.operators.ids import dense_id
from urbanframe.operators.spatial_join import bbox_join
from urbanframe.session import any_size, cut_lineage

# Fixed scenario: sun in the south, six degrees high.
SUN_AZIMUTH_DEG = 180.0
SUN_ELEVATION_DEG = 6.0

# Fixed risk bounds and texts of the published layer.
RISK_STEPS = [(0.20, "VERY_HIGH"), (0.10, "HIGH"), (0.03, "MEDIUM")]
REASONS = [
    (0.20, "Cobertura de sombra muy alta sobre el espacio verde (escenario solar fijo)"),
    (0.10, "Cobertura de sombra alta sobre el espacio verde (escenario solar fijo)"),
    (0.03, "Cobertura de sombra media sobre el espacio verde (escenario solar fijo)"),
]
REASON_LOW = "Cobertura de sombra baja sobre el espacio verde (escenario solar fijo)"
QUESTION = "¿Qué sectores de espacios verdes quedan bajo sombra proyectada en un escenario solar fijo?"


def with_model_params(df: DataFrame, azimuth: float = SUN_AZIMUTH_DEG, elevation: float = SUN_ELEVATION_DEG) -> DataFrame:
    return df.withColumns({"sun_azimuth_deg": F.lit(azimuth), "sun_elevation_deg": F.lit(elevation)})


def shadow_vectors(base: DataFrame, azimuth: float = SUN_AZIMUTH_DEG, elevation: float = SUN_ELEVATION_DEG) -> DataFrame:
    """Direction and length of each building's shadow."""
    b = base.where(G.not_empty("geom") & (F.col("height_m") > 0)).select(
        F.col("gid").alias("building_gid"), F.col("building_gml_id").cast("string").alias("source_id"),
        "height_m", "height_category", "geom", "bbox",
    )
    turned = F.col("sun_azimuth_deg") + 180.0
    length = safe_ratio(F.col("height_m"), F.tan(F.radians("sun_elevation_deg")))
    return with_model_params(b, azimuth, elevation).withColumns({
        "shadow_azimuth_deg": turned - 360.0 * F.floor(turned / 360.0),
        "shadow_length_raw": F.greatest(length, F.lit(0.0)),
    })


def _offset():
    angle = F.radians("shadow_azimuth_deg")
    return F.col("shadow_length_raw") * F.sin(angle), F.col("shadow_length_raw") * F.cos(angle)


def _hull():
    dx, dy = _offset()
    return K.st_convexhull(G.st_collect_pair("geom", G.st_translate("geom", dx, dy)))


def _shadow_box():
    dx, dy = _offset()
    b = F.col("bbox")
    return G.bbox_struct(
        b["xmin"] + F.least(dx, F.lit(0.0)), b["ymin"] + F.least(dy, F.lit(0.0)),
        b["xmax"] + F.greatest(dx, F.lit(0.0)), b["ymax"] + F.greatest(dy, F.lit(0.0)),
    )


def shadow_polygons(vectors: DataFrame) -> DataFrame:
    """Hull of each footprint and its copy at the tip of the shadow."""
    return vectors.select(
        "building_gid", "source_id", "height_m", "height_category", F.col("geom").alias("building_geom"),
        "sun_azimuth_deg", "sun_elevation_deg", "shadow_azimuth_deg",
        round_numeric("shadow_length_raw", 2).alias("shadow_length_m"), _hull().alias("shadow_geom"),
    )


def shadow_on_green(base: DataFrame, greens_near: DataFrame) -> DataFrame:
    """Shaded part of each green area per building.

    The box of a shadow follows from the footprint box, so candidates are
    joined first and hulls are built only for buildings that reach a green.
    Shadows are long and enter many cells: only their boxes go through these,
    the rest of a building follows by its row number.
    """
    v = shadow_vectors(base).withColumns({"_sbox": _shadow_box(), "_row": F.monotonically_increasing_id()})
    v = cut_lineage(v)
    g = cut_lineage(greens_near).select(F.col("id").alias("green_id"), F.col("geom").alias("_ggeom"), F.col("bbox").alias("_gbox"))
    pairs = (
        bbox_join(v.select("_row", "_sbox"), g, "_sbox", "_gbox").drop("_sbox", "_gbox")
        .join(any_size(v), "_row")
        .withColumn("_piece", K.st_intersection(_hull(), F.col("_ggeom")))
        .withColumn("_shaded", G.st_area("_piece"))
        .where(F.col("_shaded") > 0)
        .withColumn("_green", G.st_area("_ggeom"))
    )
    score = safe_ratio(F.col("_shaded"), F.col("_green"))
    rows = pairs.select(
        "building_gid", "source_id", "height_m", "height_category", "green_id", "sun_azimuth_deg",
        "sun_elevation_deg", "shadow_azimuth_deg", round_numeric("shadow_length_raw", 2).alias("shadow_length_m"),
        round_numeric(K.st_distance("geom", "_ggeom"), 2).alias("distance_to_green_m"),
        round_numeric("_shaded", 2).alias("shadow_on_green_m2"), round_numeric("_green", 2).alias("green_area_m2"),
        round_numeric(score, 4).alias("shadow_risk_score"),
        graded(score, RISK_STEPS, "LOW", strict=False).alias("shadow_risk_level"),
        graded(score, REASONS, REASON_LOW, strict=False).alias("shadow_risk_reason"),
        F.lit(QUESTION).alias("question"), F.col("_piece").alias("geom"),
    )
    return dense_id(rows, ["building_gid", "green_id"], "gid")


def high_shadow(layer: DataFrame) -> DataFrame:
    return layer.where(F.col("shadow_risk_level").isin("HIGH", "VERY_HIGH"))


def shadow_summary(layer: DataFrame) -> DataFrame:
    def level(v):
        return count_if(F.col("shadow_risk_level") == v)

    return layer.agg(
        F.count(F.lit(1)).alias("total_shadow_patches"),
        level("VERY_HIGH").alias("very_high_shadow_risk"), level("HIGH").alias("high_shadow_risk"),
        level("MEDIUM").alias("medium_shadow_risk"), level("LOW").alias("low_shadow_risk"),
        round_numeric(F.avg("height_m"), 2).alias("avg_height_m"), round_numeric(F.max("height_m"), 2).alias("max_height_m"),
        round_numeric(F.avg("shadow_length_m"), 2).alias("avg_shadow_length_m"),
        round_numeric(F.max("shadow_length_m"), 2).alias("max_shadow_length_m"),
        round_numeric(F.sum("shadow_on_green_m2"), 2).alias("total_shadow_on_green_m2"),
        round_numeric(F.avg("shadow_risk_score"), 4).alias("avg_shadow_risk_score"),
        round_numeric(F.max("shadow_risk_score"), 4).alias("max_shadow_risk_score"),
    )


def worst_shadows(layer: DataFrame, k: int = 25) -> DataFrame:
    """Worst patches first: by level, then score, then ids."""
    level = F.col("shadow_risk_level")
    order = F.when(level == "VERY_HIGH", 1).when(level == "HIGH", 2).when(level == "MEDIUM", 3).otherwise(4)
    return layer.orderBy(order, F.desc("shadow_risk_score"), "source_id", "green_id").limit(k).select(
        "source_id", "green_id", "height_m", "shadow_length_m", "shadow_on_green_m2", "shadow_risk_score",
        "shadow_risk_level", "shadow_risk_reason",
    )
