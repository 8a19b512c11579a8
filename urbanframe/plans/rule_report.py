"""Rule listings and counts straight from the store.

These work on one row per ground-surface geometry, on unrounded values, and the
counts use closed ranges, so a value on a bound may count in two classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import below, count_if, graded, round_numeric, safe_ratio
from urbanframe.operators.dissolve import dissolve
from urbanframe.operators.footprints import footprint_chain
from urbanframe.operators.spatial_join import nearest, pairs_within
from urbanframe.session import cut_lineage

# Fixed status texts of the listings.
SETBACK_TEXT = [(3, "CRITICAL: Less than 3m apart"), (6, "WARNING: May violate combined side setback (< 6m)")]
HEIGHT_WIDTH_TEXT = ("VIOLATION: Height > 1.5x street-facing width", "WARNING: Height approaching 1.5x limit")
COVERAGE_TEXT = [(0.60, "VIOLATION: Footprint > 60% of parcel (bbox proxy)"), (0.50, "WARNING: Coverage between 50-60%")]
MIN_HEIGHT_TEXT = [(3, "VIOLATION: Height < 3m"), (5, "WARNING: Very low building (3-5m)")]
MAX_HEIGHT_TEXT = [
    (50, "VIOLATION: Height > 50m (requires special permit)"), (40, "WARNING: Height 40-50m (approaching limit)"),
]
FAR_TEXT = [(3.0, "VIOLATION: FAR > 3.0"), (2.5, "WARNING: FAR 2.5-3.0")]

H = "building_height"


def building_footprints(
    feature: DataFrame, prop: DataFrame, objectclass: DataFrame, geometry_data: DataFrame
) -> DataFrame:
    chain = footprint_chain(feature, prop, objectclass, geometry_data)
    flat = G.st_force2d("footprint_3d")
    rows = chain.select(
        "building_id", "building_gml_id", "geometry_id", "ground_elevation", "roof_elevation", H,
        F.col("envelope_bbox").alias("bounding_box"), "footprint_3d", flat.alias("footprint_2d"),
        G.st_area("footprint_3d").alias("footprint_area"),
    )
    return rows.withColumn("bbox", G.st_bbox("footprint_3d"))


def dataset_overview(fp: DataFrame) -> DataFrame:
    def three(col, name):
        return [round_numeric(f(col), 2).alias(name.format(n)) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]

    return fp.agg(F.count(F.lit(1)).alias("total_buildings"), *three(H, "{}_height_m"), *three("footprint_area", "{}_footprint_m2"))


def _close_pairs(fp: DataFrame) -> DataFrame:
    rows = fp.select("building_id", "building_gml_id", F.col("footprint_2d").alias("geom"), "bbox")
    return pairs_within(rows, "building_id", "geom", "bbox", 6.0)


def setback_pairs(fp: DataFrame) -> DataFrame:
    return _close_pairs(fp).select(
        F.col("a_building_gml_id").alias("building_a"), F.col("b_building_gml_id").alias("building_b"),
        round_numeric("distance_m", 2).alias("distance_meters"),
        below(F.col("distance_m"), SETBACK_TEXT, "OK").alias("setback_status"),
    ).orderBy("distance_meters")


def setback_counts(fp: DataFrame) -> DataFrame:
    d = F.col("distance_m")
    return _close_pairs(fp).agg(count_if(d < 3).alias("critical_pairs"), count_if(d < 6).alias("warning_pairs"))


def _width() -> Column:
    return G.bbox_min_width(F.col("bounding_box"))


def _proxy_area() -> Column:
    return G.bbox_area(F.col("bounding_box"))


def _coverage() -> Column:
    return safe_ratio(F.col("footprint_area"), _proxy_area())


def _too_tall(fail, warn, ok):
    h, w = F.col(H), _width()
    return F.when(h > 1.5 * w, fail).when(h > 1.2 * w, warn).otherwise(ok)


def height_width_report(fp: DataFrame) -> DataFrame:
    b = F.col("bounding_box")
    return fp.select(
        "building_gml_id", round_numeric(H, 2).alias("height_m"),
        round_numeric(b["xmax"] - b["xmin"], 2).alias("width_east_west"),
        round_numeric(b["ymax"] - b["ymin"], 2).alias("width_north_south"),
        round_numeric(_width(), 2).alias("min_face_width_m"),
        round_numeric(safe_ratio(F.col(H), _width()), 3).alias("height_to_width_ratio"),
        _too_tall(*HEIGHT_WIDTH_TEXT, "OK").alias("rule_2_status"),
    ).orderBy(F.desc_nulls_last("height_to_width_ratio"))


def height_width_counts(fp: DataFrame) -> DataFrame:
    h, w = F.col(H), _width()
    return fp.agg(
        count_if(h > 1.5 * w).alias("rule2_violations"),
        count_if((h > 1.2 * w) & (h <= 1.5 * w)).alias("rule2_warnings"),
        count_if(h <= 1.2 * w).alias("rule2_compliant"),
    )


def bbox_coverage_report(fp: DataFrame) -> DataFrame:
    return fp.select(
        "building_gml_id", round_numeric("footprint_area", 2).alias("footprint_area_m2"),
        round_numeric(_proxy_area(), 2).alias("bbox_area_m2"), round_numeric(_coverage() * 100, 1).alias("coverage_pct"),
        graded(_coverage(), COVERAGE_TEXT, "OK").alias("rule_3_status"),
    ).orderBy(F.desc_nulls_last("coverage_pct"))


def _three_counts(fp: DataFrame, number: int, bad: Column, warn: Column, good: Column) -> DataFrame:
    return fp.agg(
        count_if(bad).alias(f"rule{number}_violations"), count_if(warn).alias(f"rule{number}_warnings"),
        count_if(good).alias(f"rule{number}_compliant"),
    )


def bbox_coverage_counts(fp: DataFrame) -> DataFrame:
    c = _coverage()
    return _three_counts(fp, 3, c > 0.60, c.between(0.50, 0.60), c <= 0.50)


def min_height_report(fp: DataFrame) -> DataFrame:
    return fp.select(
        "building_gml_id", round_numeric(H, 2).alias("height_m"), below(F.col(H), MIN_HEIGHT_TEXT, "OK").alias("rule_4_status")
    ).orderBy("height_m")


def min_height_counts(fp: DataFrame) -> DataFrame:
    h = F.col(H)
    return _three_counts(fp, 4, h < 3, h.between(3, 5), h > 5)


def height_over(fp: DataFrame, limit: float = 30.0) -> DataFrame:
    return fp.where(F.col(H) > limit)


def max_height_report(fp: DataFrame) -> DataFrame:
    return height_over(fp).select(
        "building_gml_id", round_numeric(H, 2).alias("height_m"), graded(F.col(H), MAX_HEIGHT_TEXT, "OK").alias("rule_5_status")
    ).orderBy(F.desc("height_m"))


def max_height_counts(fp: DataFrame) -> DataFrame:
    h = F.col(H)
    return _three_counts(fp, 5, h > 50, h.between(40, 50), h <= 40)


def far_report(fp: DataFrame) -> DataFrame:
    """Floors round half to even here, because the height is an unrounded double."""
    floors = F.greatest(F.lit(1.0), F.rint(F.col(H) / 3.2))
    total = F.col("footprint_area") * floors
    far = safe_ratio(total, _proxy_area())
    return fp.select(
        "building_gml_id", round_numeric(H, 2).alias("height_m"), round_numeric("footprint_area", 2).alias("footprint_m2"),
        floors.cast("int").alias("estimated_floors"), round_numeric(total, 2).alias("estimated_total_floor_area_m2"),
        round_numeric(far, 3).alias("far_ratio"), graded(far, FAR_TEXT, "OK").alias("rule_6_status"),
    ).orderBy(F.desc_nulls_last("far_ratio"))


def neighbour_distance(fp: DataFrame) -> DataFrame:
    """Smallest distance from any footprint of a building to any other building."""
    whole = dissolve(fp, ["building_id"], "footprint_2d", "geometry_id")
    rows = cut_lineage(whole).select("building_id", F.col("footprint_2d").alias("geom"), G.st_bbox("footprint_2d").alias("bbox"))
    other = rows.select("building_id", F.col("geom").alias("other_geom"), F.col("bbox").alias("other_bbox"))
    near = nearest(
        rows, other, "building_id", "building_id", "geom", "other_geom", "bbox", "other_bbox", other_only=True
    )
    return near.select("building_id", F.col("distance_m").alias("min_neighbor_dist"))


def compliance_report(fp: DataFrame) -> DataFrame:
    """Five rules per footprint; buildings without a neighbour drop out."""
    near = F.col("min_neighbor_dist")
    cols = {
        "rule1_setback": below(near, [(3, "FAIL"), (6, "WARN")], "OK"),
        "rule2_height_ratio": _too_tall("FAIL", "WARN", "OK"),
        "rule3_coverage": graded(_coverage(), [(0.60, "FAIL"), (0.50, "WARN")], "OK"),
        "rule4_min_height": below(F.col(H), [(3, "FAIL"), (5, "WARN")], "OK"),
        "rule5_max_height": graded(F.col(H), [(50, "FAIL"), (40, "WARN")], "OK"),
    }
    rows = fp.join(neighbour_distance(fp), "building_id").select(
        "building_gml_id", round_numeric(H, 2).alias("height_m"), round_numeric("footprint_area", 2).alias("footprint_m2"),
        round_numeric(near, 2).alias("nearest_building_m"), *[c.alias(n) for n, c in cols.items()],
    )
    score = sum(
        (F.when(F.col(c) == "FAIL", 2).when(F.col(c) == "WARN", 1).otherwise(0) for c in cols), F.lit(0)
    )
    return rows.orderBy(score.desc())
