"""Urban rules as layers: one layer per rule and a combined score per building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions.scalars import below, count_if, estimated_floors, graded, round_numeric, safe_ratio
from urbanframe.operators.ids import dense_id
from urbanframe.operators.spatial_join import nearest, pairs_within

SPACING_M = 6.0

# Fixed limits of the rules (bound, status).
SPACING = [(3, "FAIL"), (6, "WARN")]
HEIGHT_RATIO = [(1.5, "FAIL"), (1.2, "WARN")]
COVERAGE = [(0.60, "FAIL"), (0.50, "WARN")]
MIN_HEIGHT = [(3, "FAIL"), (5, "WARN")]
MAX_HEIGHT = [(50, "FAIL"), (40, "WARN")]
FLOOR_AREA = [(3.0, "FAIL"), (2.5, "WARN")]

# Fixed texts of the published layers.
QUESTION = {
    1: "¿Qué edificios están demasiado cerca entre sí?",
    2: "¿Qué edificios son altos respecto a su ancho mínimo?",
    3: "¿Qué edificios ocupan demasiada superficie respecto a su área aproximada?",
    4: "¿Hay edificios demasiado bajos?",
    5: "¿Qué edificios superan la altura máxima definida?",
    6: "¿Qué edificios tienen mayor densidad estimada?",
    7: "¿Qué edificios concentran más alertas urbanas según varias reglas?",
}


def height_to_width() -> Column:
    return safe_ratio(F.col("height_m"), F.col("min_face_width_m"))


def bbox_coverage() -> Column:
    return safe_ratio(F.col("footprint_area_m2"), F.col("bbox_area_m2"))


def floor_area() -> Column:
    return F.col("footprint_area_m2") * estimated_floors(F.col("height_m"))


def floor_ratio() -> Column:
    return safe_ratio(floor_area(), F.col("bbox_area_m2"))


def rule1_spacing(base: DataFrame) -> DataFrame:
    """Pairs of buildings closer than six metres, with a joining line."""
    rows = base.select("building_id", "building_gml_id", "geom", "bbox")
    pairs = pairs_within(rows, "building_id", "geom", "bbox", SPACING_M)
    line = G.st_makeline(
        F.array(
            G.first_vertex(K.st_pointonsurface("a_geom")), G.first_vertex(K.st_pointonsurface("b_geom"))
        ),
        F.col("a_geom.srid"),
    )
    layer = pairs.select(
        F.col("a_building_id").alias("building_a_id"), F.col("b_building_id").alias("building_b_id"),
        F.col("a_building_gml_id").alias("building_a_gml_id"), F.col("b_building_gml_id").alias("building_b_gml_id"),
        round_numeric("distance_m", 2).alias("distance_m"), below(F.col("distance_m"), SPACING, "OK").alias("status"),
        F.lit(QUESTION[1]).alias("question"), line.alias("geom"),
    )
    return dense_id(layer, ["distance_m", "building_a_id", "building_b_id"], "gid")


def _rule(base: DataFrame, number: int, status: Column, *cols) -> DataFrame:
    return base.select(
        "gid", "building_id", "building_gml_id", *cols, status.alias("status"),
        F.lit(QUESTION[number]).alias("question"), "geom",
    )


def rule2_height_ratio(base: DataFrame) -> DataFrame:
    return _rule(
        base, 2, graded(height_to_width(), HEIGHT_RATIO, "OK"), "height_m", "min_face_width_m",
        round_numeric(height_to_width(), 3).alias("height_to_width_ratio"),
    )


def rule3_coverage(base: DataFrame) -> DataFrame:
    return _rule(
        base, 3, graded(bbox_coverage(), COVERAGE, "OK"), "footprint_area_m2", "bbox_area_m2",
        round_numeric(bbox_coverage() * 100, 1).alias("coverage_pct"),
    )


def rule4_min_height(base: DataFrame) -> DataFrame:
    return _rule(base, 4, below(F.col("height_m"), MIN_HEIGHT, "OK"), "height_m")


def rule5_max_height(base: DataFrame) -> DataFrame:
    return _rule(base, 5, graded(F.col("height_m"), MAX_HEIGHT, "OK"), "height_m")


def rule6_far(base: DataFrame) -> DataFrame:
    return _rule(
        base, 6, graded(floor_ratio(), FLOOR_AREA, "OK"), "height_m", "footprint_area_m2", "bbox_area_m2",
        estimated_floors(F.col("height_m")).alias("estimated_floors"),
        round_numeric(floor_area(), 2).alias("estimated_total_floor_area_m2"),
        round_numeric(floor_ratio(), 3).alias("far_ratio"),
    )


def nearest_building(base: DataFrame) -> DataFrame:
    """Distance to the nearest other building; a lone building has no row."""
    me = base.select("building_id", "geom", "bbox")
    other = base.select(
        F.col("building_id"), F.col("geom").alias("other_geom"), F.col("bbox").alias("other_bbox")
    )
    near = nearest(
        me, other, "building_id", "building_id", "geom", "other_geom", "bbox", "other_bbox", other_only=True
    )
    return near.select("building_id", F.col("distance_m").alias("nearest_building_m"))


def points(status: Column) -> Column:
    return F.when(status == "FAIL", 2).when(status == "WARN", 1).otherwise(0)


RULE_COLUMNS = (
    "rule1_spacing", "rule2_height_ratio", "rule3_coverage", "rule4_min_height", "rule5_max_height", "rule6_far",
)


def combined_rules(base: DataFrame) -> DataFrame:
    """All six statuses per building, their score and a risk level."""
    near = F.col("_near")
    rows = base.join(
        nearest_building(base).withColumnRenamed("nearest_building_m", "_near"), "building_id", "left"
    ).select(
        "gid", "building_id", "building_gml_id", "height_m", "height_category", "footprint_area_m2", "bbox_area_m2",
        "min_face_width_m", round_numeric(near, 2).alias("nearest_building_m"),
        round_numeric(height_to_width(), 3).alias("height_to_width_ratio"),
        round_numeric(bbox_coverage() * 100, 1).alias("coverage_pct"),
        estimated_floors(F.col("height_m")).alias("estimated_floors"),
        round_numeric(floor_ratio(), 3).alias("far_ratio"),
        below(near, SPACING, "OK").alias("rule1_spacing"),
        graded(height_to_width(), HEIGHT_RATIO, "OK").alias("rule2_height_ratio"),
        graded(bbox_coverage(), COVERAGE, "OK").alias("rule3_coverage"),
        below(F.col("height_m"), MIN_HEIGHT, "OK").alias("rule4_min_height"),
        graded(F.col("height_m"), MAX_HEIGHT, "OK").alias("rule5_max_height"),
        graded(floor_ratio(), FLOOR_AREA, "OK").alias("rule6_far"), "geom",
    )
    score = sum((points(F.col(c)) for c in RULE_COLUMNS), F.lit(0))
    rows = rows.withColumn("risk_score", score)
    return rows.withColumns({
        "risk_level": graded(F.col("risk_score"), [(5, "HIGH"), (3, "MEDIUM"), (1, "LOW")], "OK", strict=False),
        "question": F.lit(QUESTION[7]),
    })


def rules_summary(layer: DataFrame) -> DataFrame:
    def level(v):
        return count_if(F.col("risk_level") == v)

    return layer.agg(
        F.count(F.lit(1)).alias("total_buildings"), level("HIGH").alias("high_risk"),
        level("MEDIUM").alias("medium_risk"), level("LOW").alias("low_risk"), level("OK").alias("ok_buildings"),
        round_numeric(F.avg("height_m"), 2).alias("avg_height_m"), round_numeric(F.max("height_m"), 2).alias("max_height_m"),
        round_numeric(F.avg("risk_score"), 2).alias("avg_risk_score"),
    )
