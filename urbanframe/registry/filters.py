"""Predicates, classification and projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import estimated_floors, graded, height_category, round_numeric, safe_ratio
from urbanframe.operators import filters as op
from urbanframe.plans import green, occupation, rule_report, shadow
from urbanframe.registry import city, layers
from urbanframe.registry.city import oracle
from urbanframe.registry.layers import CATEGORY, R

CLASS_SQL = "FROM features f JOIN objectclass o ON o.id = f.objectclass_id WHERE f.xmin IS NOT NULL"


def _classes(s, d):
    return city.class_geometries(s, d)


def _buildings(s, d):
    return city.relation(s, d, "buildings")


def _raw_geometry(s, d):
    """Geometry rows incl. ones without geometry, lines and empty collections."""
    g = city.geometry_data(s, d)
    k = F.col("id") % 3
    shape = (
        F.when(k == 0, F.col("geometry"))
        .when(k == 1, G.geometry("MultiLineString", F.col("geometry.parts"), 3879))
        .otherwise(G.geometry("MultiPolygon", F.filter(F.col("geometry.parts"), lambda p: F.lit(False)), 3879))
    )
    return g.select("id", F.when(F.col("geometry").isNotNull(), shape).alias("geom"))


LEVEL_RATIO = "p_size / nullif(CAST(p_partkey % 60 AS DOUBLE), 0)"


def _ratio(s, d):
    p = city.table(s, d, "part")
    return p.select("p_partkey", "p_size", safe_ratio(F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")).alias("ratio"))


ENTRIES = {
    "class_filter": (
        lambda s, d: op.class_filter(_classes(s, d), "Building").select("id", "class"),
        oracle(f"SELECT f.objectid AS id, o.classname AS class {CLASS_SQL} AND o.classname = 'Building'", "features", "objectclass"),
    ),
    "exclude_classes": (
        lambda s, d: op.exclude_classes(_classes(s, d), ["Building", "RoofSurface"]).select("id", "class"),
        oracle(f"SELECT f.objectid AS id, o.classname AS class {CLASS_SQL} AND o.classname NOT IN ('Building', 'RoofSurface')", "features", "objectclass"),
    ),
    "geometry_type_filter": (
        lambda s, d: op.drop_geometry_type(_raw_geometry(s, d)).select("id", G.st_geometrytype("geom").alias("kind")),
        oracle("SELECT id, CASE id % 3 WHEN 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM geometries WHERE gx0 IS NOT NULL AND id % 3 <> 1", "geometries"),
    ),
    "non_empty_geometry": (
        lambda s, d: op.non_empty_geometry(_raw_geometry(s, d)).select("id"),
        oracle("SELECT id FROM geometries WHERE gx0 IS NOT NULL AND id % 3 <> 2", "geometries"),
    ),
    "positive_measure_filter": (
        lambda s, d: op.positive(city.table(s, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"),
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
    ),
    "tall_near_green": (
        lambda s, d: green.tall_near_green(layers.near_green_layer(s, d)).select("gid", "height_m", "distance_to_green_m"),
        layers._g("SELECT gid, height_m, distance_to_green_m FROM near_pts WHERE height_m >= 25 AND distance_to_green_m <= 100"),
    ),
    "high_shadow": (
        lambda s, d: shadow.high_shadow(layers.shadow_layer(s, d)).select(
            "building_gid", "green_id", "shadow_risk_level", "shadow_on_green_m2", "distance_to_green_m"
        ),
        layers._s(
            "SELECT building_gid, green_id, shadow_risk_level, shadow_on_green_m2, distance_to_green_m FROM shadows "
            "WHERE shadow_risk_level IN ('HIGH', 'VERY_HIGH')"
        ),
    ),
    "height_over_30": (
        lambda s, d: rule_report.height_over(layers.footprints(s, d)).select("building_gml_id", "building_height").orderBy(F.desc("building_height")),
        layers._f(f"WITH {layers.FP} SELECT building_gml_id, building_height FROM fp WHERE building_height > 30"),
    ),
    "toplevel_filter": (
        lambda s, d: op.toplevel_only(city.feature(s, d), city.dictionary(s, "objectclass")).select("id", "objectid"),
        oracle("SELECT f.id, f.objectid FROM features f JOIN objectclass o ON o.id = f.objectclass_id WHERE o.is_toplevel > 0", "features", "objectclass"),
    ),
    "height_category": (
        lambda s, d: _buildings(s, d).select("k", height_category(F.col("height_m")).alias("height_category")),
        oracle(f"SELECT k, {CATEGORY.format(h='height_m')} AS height_category FROM buildings", "buildings"),
    ),
    "coverage_level": (
        lambda s, d: _ratio(s, d).select("p_partkey", graded(F.col("ratio"), occupation.COVERAGE_STEPS, "LOW").alias("level")),
        f"SELECT p_partkey, CASE WHEN {LEVEL_RATIO} > 0.6 THEN 'HIGH' WHEN {LEVEL_RATIO} > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM part",
    ),
    "fos_level": (
        lambda s, d: layers.fos_layer(s, d).select("parcel_id", "fos_level"),
        layers._p("SELECT parcel_id, fos_level FROM fos", layers.FOS_CTES),
    ),
    "far_level": (
        lambda s, d: layers.far_layer(s, d).select("parcel_id", "far_level"),
        layers._p("SELECT parcel_id, far_level FROM far", layers.FAR_CTES),
    ),
    "shadow_risk_level": (
        lambda s, d: _ratio(s, d).select(
            "p_partkey", graded(F.col("ratio"), shadow.RISK_STEPS, "LOW", strict=False).alias("level"),
            graded(F.col("ratio"), shadow.REASONS, shadow.REASON_LOW, strict=False).alias("reason"),
        ),
        "SELECT p_partkey, CASE WHEN r >= 0.2 THEN 'VERY_HIGH' WHEN r >= 0.1 THEN 'HIGH' WHEN r >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS level, "
        + "CASE " + " ".join(f"WHEN r >= {b} THEN '{t}'" for b, t in shadow.REASONS) + f" ELSE '{shadow.REASON_LOW}' END AS reason "
        + f"FROM (SELECT p_partkey, {LEVEL_RATIO} AS r FROM part)",
    ),
    "safe_ratio": (
        lambda s, d: _ratio(s, d).select("p_partkey", "ratio", F.coalesce("ratio", F.lit(0.0)).alias("ratio_or_zero")),
        f"SELECT p_partkey, {LEVEL_RATIO} AS ratio, coalesce({LEVEL_RATIO}, 0) AS ratio_or_zero FROM part",
    ),
    "estimated_floors": (
        lambda s, d: _buildings(s, d).select("k", estimated_floors(F.col("height_m")).alias("floors")),
        oracle(f"SELECT k, {layers.FLOORS} AS floors FROM buildings", "buildings"),
    ),
    "model_params": (
        lambda s, d: shadow.with_model_params(_buildings(s, d)).select("k", "sun_azimuth_deg", "sun_elevation_deg"),
        oracle("SELECT k, CAST(180 AS DOUBLE) AS sun_azimuth_deg, CAST(6 AS DOUBLE) AS sun_elevation_deg FROM buildings", "buildings"),
    ),
    "tag_question": (
        lambda s, d: _buildings(s, d).select("k", F.lit(occupation.QUESTION_FOS).alias("question")),
        oracle(f"SELECT k, '{occupation.QUESTION_FOS}' AS question FROM buildings", "buildings"),
    ),
    "distinct_layer": (
        lambda s, d: op.distinct_layer(
            city.greens(s, d).unionByName(city.greens(s, d)), ["id", "geom"]
        ).select("id", G.st_area("geom").alias("area")),
        oracle("SELECT id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM greens", "greens"),
    ),
    "distinct_on": (
        lambda s, d: op.distinct_on(
            city.table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]
        ).select("o_custkey", "o_orderkey", "o_totalprice"),
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    ),
    "round_numeric": (
        lambda s, d: city.table(s, d, "customer").select(
            "c_custkey", round_numeric("c_acctbal", 1).alias("one"), round_numeric(F.col("c_acctbal") / 7, 3).alias("three")
        ),
        f"SELECT c_custkey, {R('c_acctbal', 1)} AS one, {R('c_acctbal / 7', 3)} AS three FROM customer",
    ),
}
