"""Analysis layers: whole queries with oracle SQL on the closed forms of rectangles."""

from __future__ import annotations

import zlib

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import round_numeric
from urbanframe.plans import base as base_plan
from urbanframe.plans import density, green, occupation, rule_report, rules, shadow
from urbanframe.registry import city
from urbanframe.registry.city import oracle
from urbanframe.sources.catalogue import Catalogue


def _plain(df):
    """Drop geometry columns for the comparison."""
    return df.drop("geom", "bbox", "footprint_3d", "footprint_2d", "building_geom", "shadow_geom", "bounding_box")


_CATALOGUES: dict[tuple, Catalogue] = {}


def catalogue(spark, sf) -> Catalogue:
    """The analysis layers over one derived city, in build order."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CATALOGUES:
        c = _CATALOGUES[key] = Catalogue(spark, f"analysis_{zlib.crc32(sf.encode()):08x}")
        store = lambda: (
            city.feature(spark, sf), city.property_rows(spark, sf), city.dictionary(spark, "objectclass"), city.geometry_data(spark, sf)
        )
        c.define("urban_building_base", lambda: base_plan.building_base(*store()))
        c.define("urban_building_base_extended", lambda: base_plan.building_base(*store(), True))
        c.define("building_footprints", lambda: rule_report.building_footprints(*store()))
        c.define("building_height_points", lambda: green.building_height_points(city.class_geometries(spark, sf)))
        c.define("green_areas_near_model", lambda pts: green.green_near_model(city.greens(spark, sf), pts), ["building_height_points"])
        c.define("buildings_near_green", green.buildings_near_green, ["building_height_points", "green_areas_near_model"])
        c.define("high_buildings_near_green", green.tall_near_green, ["buildings_near_green"], view=True)
        c.define("buildings_clean", occupation.buildings_clean, ["urban_building_base"])
        c.define("parcels_clean", lambda clean: occupation.parcels_clean(city.parcels(spark, sf), clean), ["buildings_clean"])
        c.define("building_parcel_intersections", occupation.building_parcel_intersections, ["buildings_clean", "parcels_clean"])
        c.define("building_parcel_coverage", occupation.building_parcel_coverage, ["building_parcel_intersections"], view=True)
        c.define("parcel_fos", occupation.parcel_fos, ["parcels_clean", "building_parcel_intersections"])
        c.define("building_far_estimate", density.building_far_estimate, ["building_parcel_intersections"])
        c.define("parcel_far", density.parcel_far, ["parcels_clean", "building_far_estimate"])
        c.define("shadow_risk_green", shadow.shadow_on_green, ["urban_building_base", "green_areas_near_model"])
        c.define("high_shadow_risk_green", shadow.high_shadow, ["shadow_risk_green"], view=True)
        c.define("combined_rules", rules.combined_rules, ["urban_building_base_extended"])
    return _CATALOGUES[key]


def saved(spark, sf, name):
    """A layer as saved, for queries that build on it."""
    return catalogue(spark, sf).table(name)


def fresh(spark, sf, name):
    """A layer computed from its saved inputs, for the query of the layer itself."""
    return catalogue(spark, sf).fresh(name)


def base_layer(spark, sf, extended=False):
    return saved(spark, sf, "urban_building_base_extended" if extended else "urban_building_base")


def footprints(spark, sf):
    return saved(spark, sf, "building_footprints")


def points_layer(spark, sf):
    return saved(spark, sf, "building_height_points")


def near_green_layer(spark, sf):
    return saved(spark, sf, "buildings_near_green")


def greens_near(spark, sf):
    return saved(spark, sf, "green_areas_near_model")


def occupation_inputs(spark, sf):
    return saved(spark, sf, "parcels_clean"), saved(spark, sf, "building_parcel_intersections")


def fos_layer(spark, sf):
    return saved(spark, sf, "parcel_fos")


def estimates_layer(spark, sf):
    return saved(spark, sf, "building_far_estimate")


def far_layer(spark, sf):
    return saved(spark, sf, "parcel_far")


def shadow_layer(spark, sf):
    return saved(spark, sf, "shadow_risk_green")


def combined_layer(spark, sf):
    return saved(spark, sf, "combined_rules")


# ---------------------------------------------------------------- oracle pieces
def R(expr: str, n: int) -> str:
    """Rounding half away from zero on fifteen decimal digits of the double."""
    return f"CAST(ROUND(CAST(printf('%.14e', CAST({expr} AS DOUBLE)) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


CATEGORY = (
    "CASE WHEN {h} >= 40 THEN 'muy_alto' WHEN {h} >= 25 THEN 'alto' WHEN {h} >= 12 THEN 'medio' ELSE 'bajo' END"
)
# Envelope height as the store holds it: (z + height) - z.
HEIGHT = "((z + height_m) - z)"
TOP = "(CASE WHEN k % 4 = 0 THEN y1 + 12 ELSE y1 END)"
ARM_AREA = "(CASE WHEN k % 4 = 0 THEN ((x1 - x0) // 4) * 12 ELSE 0 END)"

POINTS = f"""pts AS (
  SELECT row_number() OVER (ORDER BY 'B' || k) AS gid, 'B' || k AS source_id, 'Building' AS object_class,
         {R(HEIGHT, 2)} AS height_m, {CATEGORY.format(h=HEIGHT)} AS height_category,
         (x0 + x1) / 2.0 AS px, (y0 + {TOP}) / 2.0 AS py
  FROM buildings)"""
GREEN_DIST = (
    "sqrt(power(greatest(0, g.x0 - p.px, p.px - g.x1), 2) + power(greatest(0, g.y0 - p.py, p.py - g.y1), 2))"
)
NEAR_GREENS = f"""near_greens AS (
  SELECT g.* FROM greens g WHERE EXISTS (SELECT 1 FROM pts p WHERE {GREEN_DIST} <= 500))"""
NEAR_PTS = f"""near_pts AS (
  SELECT gid, source_id, object_class, height_m, height_category, green_id, {R('d', 2)} AS distance_to_green_m
  FROM (SELECT p.*, g.id AS green_id, {GREEN_DIST} AS d,
               row_number() OVER (PARTITION BY p.gid ORDER BY {GREEN_DIST}, g.id) AS rn
        FROM pts p, near_greens g) WHERE rn = 1)"""
GREEN_CTES = f"{POINTS}, {NEAR_GREENS}, {NEAR_PTS}"

BASE = f"""base AS (
  SELECT row_number() OVER (ORDER BY k) AS gid, k AS building_id, 'B' || k AS building_gml_id,
         {R('CAST(z AS DOUBLE)', 2)} AS ground_elevation_m, {R('z + height_m', 2)} AS roof_elevation_m,
         {R(HEIGHT, 2)} AS height_m, {CATEGORY.format(h=HEIGHT)} AS height_category,
         CAST((x1 - x0) * (y1 - y0) + {ARM_AREA} AS DOUBLE) AS footprint_area_m2,
         CAST((x1 - x0) * ({TOP} - y0) AS DOUBLE) AS bbox_area_m2,
         CAST(least(x1 - x0, {TOP} - y0) AS DOUBLE) AS min_face_width_m
  FROM buildings)"""

OVERLAP = (
    "greatest(0, least(s.x1, p.x1) - greatest(s.x0, p.x0)) * greatest(0, least(s.y1, p.y1) - greatest(s.y0, p.y0))"
)
# Parcels within 100 m of the model envelope; pieces and their areas.
PIECES = f"""extent AS (SELECT min(x0) AS ex0, min(y0) AS ey0, max(x1) AS ex1, max(y1) AS ey1 FROM surfaces),
clean_parcels AS (
  SELECT CAST(id AS VARCHAR) AS parcel_id, x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area
  FROM parcels, extent
  WHERE power(greatest(0, x0 - ex1, ex0 - x1), 2) + power(greatest(0, y0 - ey1, ey0 - y1), 2) <= 10000),
raw_pieces AS (
  SELECT s.k, p.parcel_id, any_value(p.area) AS area, CAST(sum({OVERLAP}) AS DOUBLE) AS piece
  FROM surfaces s JOIN clean_parcels p ON s.x1 >= p.x0 AND s.x0 <= p.x1 AND s.y1 >= p.y0 AND s.y0 <= p.y1
  GROUP BY s.k, p.parcel_id HAVING sum({OVERLAP}) > 0),
pieces AS (
  SELECT row_number() OVER (ORDER BY b.gid, r.parcel_id) AS id, b.gid, b.building_id, b.building_gml_id, r.parcel_id,
         b.height_m, b.height_category, b.footprint_area_m2, r.area AS parcel_area_m2, r.piece AS intersection_area_m2,
         {R('r.piece / r.area * 100', 2)} AS intersection_coverage_pct,
         row_number() OVER (PARTITION BY b.gid ORDER BY r.piece DESC, r.parcel_id) AS parcel_rank
  FROM raw_pieces r JOIN base b ON b.building_id = r.k)"""
PIECE_CTES = f"{BASE}, {PIECES}"

# Union area per parcel by coordinate compression over the clipped rectangles.
FOS = f"""clips AS (
  SELECT p.parcel_id, greatest(s.x0, p.x0) AS x0, greatest(s.y0, p.y0) AS y0, least(s.x1, p.x1) AS x1, least(s.y1, p.y1) AS y1
  FROM surfaces s JOIN clean_parcels p ON s.x1 > p.x0 AND s.x0 < p.x1 AND s.y1 > p.y0 AND s.y0 < p.y1),
xs AS (SELECT parcel_id, x, lead(x) OVER (PARTITION BY parcel_id ORDER BY x) AS xn
       FROM (SELECT parcel_id, x0 AS x FROM clips UNION SELECT parcel_id, x1 FROM clips)),
ys AS (SELECT parcel_id, y, lead(y) OVER (PARTITION BY parcel_id ORDER BY y) AS yn
       FROM (SELECT parcel_id, y0 AS y FROM clips UNION SELECT parcel_id, y1 FROM clips)),
occupied AS (
  SELECT xs.parcel_id, CAST(sum((xn - x) * (yn - y)) AS DOUBLE) AS occ
  FROM xs JOIN ys ON xs.parcel_id = ys.parcel_id
  WHERE xn IS NOT NULL AND yn IS NOT NULL AND EXISTS (
    SELECT 1 FROM clips c WHERE c.parcel_id = xs.parcel_id AND c.x0 <= x AND c.x1 >= xn AND c.y0 <= y AND c.y1 >= yn)
  GROUP BY xs.parcel_id),
measures AS (
  SELECT parcel_id, count(DISTINCT building_gml_id) AS n, max(height_m) AS mh, avg(height_m) AS ah FROM pieces GROUP BY parcel_id),
fos AS (
  SELECT row_number() OVER (ORDER BY p.parcel_id) AS gid, p.parcel_id, coalesce(n, 0) AS buildings_count,
         p.area AS parcel_area_m2, coalesce(occ, 0) AS occupied_area_m2,
         {R('least(100, coalesce(occ, 0) / p.area * 100)', 2)} AS fos_pct,
         {R('coalesce(mh, 0)', 2)} AS max_building_height_m, {R('coalesce(ah, 0)', 2)} AS avg_building_height_m,
         CASE WHEN coalesce(occ, 0) / p.area > 0.6 THEN 'HIGH' WHEN coalesce(occ, 0) / p.area > 0.4 THEN 'MEDIUM'
              WHEN coalesce(occ, 0) > 0 THEN 'LOW' ELSE 'EMPTY' END AS fos_level
  FROM clean_parcels p LEFT JOIN occupied o USING (parcel_id) LEFT JOIN measures m USING (parcel_id))"""
FOS_CTES = f"{PIECE_CTES}, {FOS}"

FLOORS = "greatest(1, CAST(ROUND(CAST(CAST(CAST(height_m / 3.2 AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), 0) AS INTEGER))"
FAR = f"""estimates AS (
  SELECT row_number() OVER (ORDER BY parcel_id, gid) AS id, gid AS building_gid, building_id, building_gml_id, parcel_id,
         height_m, height_category, footprint_area_m2, parcel_area_m2, intersection_area_m2,
         {FLOORS} AS estimated_floors, {R(f'intersection_area_m2 * {FLOORS}', 2)} AS estimated_floor_area_m2,
         {R(f'intersection_area_m2 * {FLOORS} / parcel_area_m2', 3)} AS building_far_contribution
  FROM pieces),
far_sums AS (
  SELECT parcel_id, count(DISTINCT building_gml_id) AS n, sum(intersection_area_m2) AS occ, sum(estimated_floor_area_m2) AS fa,
         max(height_m) AS mh, avg(height_m) AS ah, max(estimated_floors) AS mf, avg(estimated_floors) AS af
  FROM estimates GROUP BY parcel_id),
far AS (
  SELECT row_number() OVER (ORDER BY p.parcel_id) AS gid, p.parcel_id, coalesce(n, 0) AS buildings_count,
         p.area AS parcel_area_m2, {R('coalesce(occ, 0)', 2)} AS occupied_area_m2,
         {R('coalesce(fa, 0)', 2)} AS estimated_floor_area_m2, {R('coalesce(fa, 0) / p.area', 3)} AS far_ratio,
         {R('coalesce(mh, 0)', 2)} AS max_building_height_m, {R('coalesce(ah, 0)', 2)} AS avg_building_height_m,
         CAST(coalesce(mf, 0) AS INTEGER) AS max_estimated_floors, {R('coalesce(af, 0)', 2)} AS avg_estimated_floors,
         CASE WHEN coalesce(fa, 0) / p.area >= 3 THEN 'HIGH' WHEN coalesce(fa, 0) / p.area >= 1.5 THEN 'MEDIUM'
              WHEN coalesce(fa, 0) > 0 THEN 'LOW' ELSE 'EMPTY' END AS far_level
  FROM clean_parcels p LEFT JOIN far_sums USING (parcel_id))"""
FAR_CTES = f"{PIECE_CTES}, {FAR}"

# Sun in the south: a shadow is the footprint stretched north. Over [x0, x1] its upper border is flat up to the
# arm's right side xa and then falls straight to the corner of the main rectangle, so the overlap with a green
# rectangle is a flat part plus the integral of a clamped line.
LENGTH = "height_m / tan(radians(6.0))"


def _ramp(t):
    return (
        f"(CASE WHEN {t} <= lo THEN 0 WHEN {t} <= hi THEN power({t} - lo, 2) / 2 "
        f"ELSE power(hi - lo, 2) / 2 + (hi - lo) * ({t} - hi) END)"
    )


SHADOWS = f"""cast_shadows AS (
  SELECT k, height_m, {LENGTH} AS len, x0, x1, y0, z, CASE WHEN k % 4 = 0 THEN x0 + (x1 - x0) // 4 ELSE x1 END AS xa,
         {TOP} + {LENGTH} AS top, CASE WHEN k % 4 = 0 THEN 12.0 / (x1 - x0 - (x1 - x0) // 4) ELSE 0 END AS slope
  FROM (SELECT k, x0, x1, y0, y1, z, {R(HEIGHT, 2)} AS height_m FROM buildings)),
clamped AS (
  SELECT c.*, g.id AS green_id, CAST((g.x1 - g.x0) * (g.y1 - g.y0) AS DOUBLE) AS green_area,
         greatest(c.x0, g.x0) AS xl, least(c.x1, g.x1) AS xr, greatest(c.y0, g.y0) AS lo, CAST(g.y1 AS DOUBLE) AS hi,
         g.x0 AS gx0, g.x1 AS gx1, g.y0 AS gy0, g.y1 AS gy1
  FROM cast_shadows c JOIN near_greens g ON g.x0 < c.x1 AND g.x1 > c.x0 AND g.y0 < c.top AND g.y1 > c.y0),
shade_cover AS (
  SELECT *, ROUND(greatest(0, least(hi, top) - lo) * greatest(0, least(xr, xa) - xl)
            + CASE WHEN slope > 0 AND xr > greatest(xl, xa) THEN
                ({_ramp('(top - slope * (greatest(xl, xa) - xa))')} - {_ramp('(top - slope * (xr - xa))')}) / slope ELSE 0 END, 9) AS shaded
  FROM clamped WHERE hi > lo),
green_distances AS (
  SELECT s.k, g.id AS green_id, min(sqrt(power(greatest(0, g.x0 - s.x1, s.x0 - g.x1), 2) + power(greatest(0, g.y0 - s.y1, s.y0 - g.y1), 2))) AS d
  FROM surfaces s, near_greens g GROUP BY s.k, g.id),
shadows AS (
  SELECT row_number() OVER (ORDER BY b.gid, o.green_id) AS gid, b.gid AS building_gid, b.building_gml_id AS source_id,
         b.height_m, b.height_category, o.green_id, CAST(180 AS DOUBLE) AS sun_azimuth_deg, CAST(6 AS DOUBLE) AS sun_elevation_deg,
         CAST(0 AS DOUBLE) AS shadow_azimuth_deg, {R('len', 2)} AS shadow_length_m, {R('d', 2)} AS distance_to_green_m,
         {R('shaded', 2)} AS shadow_on_green_m2, green_area AS green_area_m2, {R('shaded / green_area', 4)} AS shadow_risk_score,
         CASE WHEN shaded / green_area >= 0.2 THEN 'VERY_HIGH' WHEN shaded / green_area >= 0.1 THEN 'HIGH'
              WHEN shaded / green_area >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS shadow_risk_level,
         CASE {" ".join(f"WHEN shaded / green_area >= {b} THEN '{t}'" for b, t in shadow.REASONS)} ELSE '{shadow.REASON_LOW}' END AS shadow_risk_reason,
         '{shadow.QUESTION}' AS question
  FROM shade_cover o JOIN base b ON b.building_id = o.k JOIN green_distances g ON g.k = o.k AND g.green_id = o.green_id
  WHERE shaded > 0)"""
SHADOW_CTES = f"{POINTS}, {NEAR_GREENS}, {BASE}, {SHADOWS}"

SPACING = "sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))"
PAIRS = f"""close_pairs AS (
  SELECT a.k AS ka, b.k AS kb, min({SPACING}) AS d FROM surfaces a JOIN surfaces b ON b.k > a.k GROUP BY a.k, b.k),
neighbours AS (
  SELECT k, min(d) AS near FROM (SELECT ka AS k, d FROM close_pairs UNION ALL SELECT kb, d FROM close_pairs) GROUP BY k)"""


def status_sql(value, steps, op=">", default="OK"):
    body = " ".join(f"WHEN {value} {op} {b} THEN '{t}'" for b, t in steps)
    return f"CASE {body} ELSE '{default}' END"


RATIO2 = "height_m / nullif(min_face_width_m, 0)"
RATIO3 = "footprint_area_m2 / nullif(bbox_area_m2, 0)"
RATIO6 = f"footprint_area_m2 * {FLOORS} / nullif(bbox_area_m2, 0)"
COMBINED = f"""ruled AS (
  SELECT gid, building_id, building_gml_id, height_m, height_category, footprint_area_m2, bbox_area_m2, min_face_width_m,
         {R('near', 2)} AS nearest_building_m, {R(RATIO2, 3)} AS height_to_width_ratio,
         {R(RATIO3 + ' * 100', 1)} AS coverage_pct, {FLOORS} AS estimated_floors, {R(RATIO6, 3)} AS far_ratio,
         {status_sql('near', rules.SPACING, '<')} AS rule1_spacing, {status_sql(RATIO2, rules.HEIGHT_RATIO)} AS rule2_height_ratio,
         {status_sql(RATIO3, rules.COVERAGE)} AS rule3_coverage, {status_sql('height_m', rules.MIN_HEIGHT, '<')} AS rule4_min_height,
         {status_sql('height_m', rules.MAX_HEIGHT)} AS rule5_max_height, {status_sql(RATIO6, rules.FLOOR_AREA)} AS rule6_far
  FROM base LEFT JOIN neighbours ON k = building_id),
combined AS (
  SELECT *, CASE WHEN risk_score >= 5 THEN 'HIGH' WHEN risk_score >= 3 THEN 'MEDIUM' WHEN risk_score >= 1 THEN 'LOW' ELSE 'OK' END AS risk_level
  FROM (SELECT *, {' + '.join(f"CASE {c} WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END" for c in rules.RULE_COLUMNS)} AS risk_score
        FROM ruled))"""
COMBINED_CTES = f"{BASE}, {PAIRS}, {COMBINED}"

FP = f"""fp AS (
  SELECT s.sid, s.k AS building_id, 'B' || s.k AS building_gml_id, CAST(b.z AS DOUBLE) AS ground_elevation,
         b.z + b.height_m AS roof_elevation, ((b.z + b.height_m) - b.z) AS building_height,
         CAST((s.x1 - s.x0) * (s.y1 - s.y0) AS DOUBLE) AS footprint_area,
         CAST(b.x1 - b.x0 AS DOUBLE) AS w, CAST((CASE WHEN b.k % 4 = 0 THEN b.y1 + 12 ELSE b.y1 END) - b.y0 AS DOUBLE) AS h,
         s.x0, s.y0, s.x1, s.y1
  FROM surfaces s JOIN buildings b ON b.k = s.k)"""
FP_PAIRS = f"""fp_pairs AS (
  SELECT a.building_gml_id AS ga, b.building_gml_id AS gb, {SPACING} AS d
  FROM fp a JOIN fp b ON b.building_id > a.building_id)"""
COVER = "footprint_area / nullif(w * h, 0)"
FP_FLOORS = "greatest(1, round_even(building_height / 3.2, 0))"
FP_FAR = f"footprint_area * {FP_FLOORS} / nullif(w * h, 0)"


def _counts(n, bad, warn, good):
    return (
        f"WITH {FP} SELECT count(*) FILTER (WHERE {bad}) AS rule{n}_violations, count(*) FILTER (WHERE {warn}) AS rule{n}_warnings, "
        f"count(*) FILTER (WHERE {good}) AS rule{n}_compliant FROM fp"
    )


def _g(body):
    return oracle(f"WITH {GREEN_CTES} {body}", "buildings", "greens")


def _p(body, ctes=PIECE_CTES):
    return oracle(f"WITH {ctes} {body}", "surfaces", "parcels")


def _s(body):
    return oracle(f"WITH {SHADOW_CTES} {body}", "surfaces", "greens")


def _b(body, ctes=BASE):
    return oracle(f"WITH {ctes} {body}", "surfaces")


def _f(body):
    return oracle(body, "surfaces")


BASE_COLS = "gid, building_id, building_gml_id, ground_elevation_m, roof_elevation_m, height_m, height_category, footprint_area_m2"


def _rule_entry(number, fn, cols, status):
    return (
        lambda s, d, fn=fn: _plain(fn(base_layer(s, d, True))),
        _b(f"SELECT gid, building_id, building_gml_id, {cols}, {status} AS status, '{rules.QUESTION[number]}' AS question FROM base"),
    )


ENTRIES = {
    "building_base": (lambda s, d: _plain(fresh(s, d, "urban_building_base")), _b(f"SELECT {BASE_COLS} FROM base")),
    "building_base_extended": (
        lambda s, d: _plain(fresh(s, d, "urban_building_base_extended")),
        _b(f"SELECT {BASE_COLS}, bbox_area_m2, min_face_width_m FROM base"),
    ),
    "building_height_points": (
        lambda s, d: fresh(s, d, "building_height_points").selectExpr("gid", "source_id", "object_class", "height_m", "height_category", "bbox.xmin AS px", "bbox.ymin AS py"),
        _g("SELECT gid, source_id, object_class, height_m, height_category, px, py FROM pts"),
    ),
    "green_near_model": (
        lambda s, d: fresh(s, d, "green_areas_near_model").selectExpr("id", "bbox.xmin AS x0", "bbox.ymax AS y1"),
        _g("SELECT id, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM near_greens"),
    ),
    "buildings_near_green": (lambda s, d: _plain(fresh(s, d, "buildings_near_green")), _g("SELECT * FROM near_pts")),
    "high_buildings_near_green": (
        lambda s, d: _plain(green.tall_near_green(fresh(s, d, "buildings_near_green"))),
        _g("SELECT * FROM near_pts WHERE height_m >= 25 AND distance_to_green_m <= 100"),
    ),
    "tall_green_summary": (
        lambda s, d: green.tall_green_summary(green.tall_near_green(near_green_layer(s, d))),
        _g(
            f"SELECT count(*) AS high_buildings_near_green, {R('avg(height_m)', 2)} AS avg_height_m, {R('min(height_m)', 2)} AS min_height_m, "
            f"{R('max(height_m)', 2)} AS max_height_m, {R('avg(distance_to_green_m)', 2)} AS avg_distance_to_green_m, "
            f"{R('min(distance_to_green_m)', 2)} AS min_distance_to_green_m, {R('max(distance_to_green_m)', 2)} AS max_distance_to_green_m "
            "FROM near_pts WHERE height_m >= 25 AND distance_to_green_m <= 100"
        ),
    ),
    "tall_green_by_category": (
        lambda s, d: green.tall_green_by_category(green.tall_near_green(near_green_layer(s, d))),
        _g(
            f"SELECT height_category, count(*) AS buildings, {R('avg(height_m)', 2)} AS avg_height_m, "
            f"{R('avg(distance_to_green_m)', 2)} AS avg_distance_to_green_m FROM near_pts "
            "WHERE height_m >= 25 AND distance_to_green_m <= 100 GROUP BY height_category"
        ),
    ),
    "buildings_clean": (
        lambda s, d: _plain(fresh(s, d, "buildings_clean")),
        _b("SELECT gid, building_id, building_gml_id, height_m, height_category, footprint_area_m2 FROM base"),
    ),
    "parcels_clean": (
        lambda s, d: fresh(s, d, "parcels_clean").selectExpr("parcel_id", "bbox.xmin AS x0", "bbox.ymin AS y0"),
        _p("SELECT parcel_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0 FROM clean_parcels"),
    ),
    "building_parcel_intersections": (
        lambda s, d: _plain(fresh(s, d, "building_parcel_intersections")),
        _p(f"SELECT *, '{occupation.QUESTION_PIECES}' AS question FROM pieces"),
    ),
    "building_parcel_coverage": (
        lambda s, d: _plain(occupation.building_parcel_coverage(occupation_inputs(s, d)[1])),
        _p(
            "SELECT gid, building_id, building_gml_id, parcel_id, height_m, height_category, footprint_area_m2, parcel_area_m2, "
            f"intersection_area_m2, {R('intersection_area_m2 / parcel_area_m2 * 100', 2)} AS building_parcel_coverage_pct, "
            "CASE WHEN intersection_area_m2 / parcel_area_m2 > 0.6 THEN 'HIGH' WHEN intersection_area_m2 / parcel_area_m2 > 0.4 THEN 'MEDIUM' "
            f"ELSE 'LOW' END AS coverage_level, '{occupation.QUESTION_COVERAGE}' AS question FROM pieces WHERE parcel_rank = 1"
        ),
    ),
    "parcel_fos": (
        lambda s, d: _plain(fresh(s, d, "parcel_fos")), _p(f"SELECT *, '{occupation.QUESTION_FOS}' AS question FROM fos", FOS_CTES),
    ),
    "fos_summary": (
        lambda s, d: occupation.fos_summary(fos_layer(s, d)),
        _p(
            "SELECT count(*) AS total_parcels, count(*) FILTER (WHERE fos_level = 'HIGH') AS high_fos_parcels, "
            "count(*) FILTER (WHERE fos_level = 'MEDIUM') AS medium_fos_parcels, count(*) FILTER (WHERE fos_level = 'LOW') AS low_fos_parcels, "
            f"count(*) FILTER (WHERE fos_level = 'EMPTY') AS empty_parcels, {R('avg(fos_pct)', 2)} AS avg_fos_pct, {R('min(fos_pct)', 2)} AS min_fos_pct, "
            f"{R('max(fos_pct)', 2)} AS max_fos_pct, {R('avg(parcel_area_m2)', 2)} AS avg_parcel_area_m2, "
            f"{R('avg(occupied_area_m2)', 2)} AS avg_occupied_area_m2 FROM fos", FOS_CTES,
        ),
    ),
    "impossible_fos": (
        lambda s, d: occupation.impossible_fos(fos_layer(s, d)),
        _p("SELECT parcel_id, parcel_area_m2, occupied_area_m2, fos_pct, buildings_count FROM fos WHERE fos_pct > 100", FOS_CTES),
    ),
    "building_far_estimate": (
        lambda s, d: _plain(fresh(s, d, "building_far_estimate")),
        _p(f"SELECT *, '{density.QUESTION_ESTIMATE}' AS question FROM estimates", FAR_CTES),
    ),
    "parcel_far": (lambda s, d: _plain(fresh(s, d, "parcel_far")), _p(f"SELECT *, '{density.QUESTION_FAR}' AS question FROM far", FAR_CTES)),
    "far_summary": (
        lambda s, d: density.far_summary(far_layer(s, d)),
        _p(
            "SELECT count(*) AS total_parcels, count(*) FILTER (WHERE far_level = 'HIGH') AS high_far_parcels, "
            "count(*) FILTER (WHERE far_level = 'MEDIUM') AS medium_far_parcels, count(*) FILTER (WHERE far_level = 'LOW') AS low_far_parcels, "
            f"count(*) FILTER (WHERE far_level = 'EMPTY') AS empty_parcels, {R('avg(far_ratio)', 3)} AS avg_far_ratio, "
            f"{R('min(far_ratio)', 3)} AS min_far_ratio, {R('max(far_ratio)', 3)} AS max_far_ratio, {R('avg(parcel_area_m2)', 2)} AS avg_parcel_area_m2, "
            f"{R('avg(estimated_floor_area_m2)', 2)} AS avg_estimated_floor_area_m2, {R('avg(max_building_height_m)', 2)} AS avg_max_building_height_m "
            "FROM far", FAR_CTES,
        ),
    ),
    "shadow_vectors": (
        lambda s, d: shadow.shadow_vectors(base_layer(s, d)).select(
            "building_gid", "source_id", "sun_azimuth_deg", "shadow_azimuth_deg", round_numeric("shadow_length_raw", 2).alias("shadow_length_m")
        ),
        _b(
            "SELECT gid AS building_gid, building_gml_id AS source_id, CAST(180 AS DOUBLE) AS sun_azimuth_deg, CAST(0 AS DOUBLE) AS shadow_azimuth_deg, "
            f"{R(LENGTH, 2)} AS shadow_length_m FROM base WHERE height_m > 0"
        ),
    ),
    "shadow_polygons": (
        lambda s, d: shadow.shadow_polygons(shadow.shadow_vectors(base_layer(s, d))).select(
            "building_gid", "source_id", "shadow_length_m", round_numeric(G.st_area("shadow_geom"), 2).alias("shadow_area_m2")
        ),
        oracle(
            f"WITH {BASE}, wide AS (SELECT b.gid, b.building_gml_id, {LENGTH.replace('height_m', 'b.height_m')} AS len, x1 - x0 AS w, {TOP} - y0 AS h, "
            "CASE WHEN k % 4 = 0 THEN x1 - x0 - (x1 - x0) // 4 ELSE 0 END AS cut FROM base b JOIN buildings ON k = building_id) "
            f"SELECT gid AS building_gid, building_gml_id AS source_id, {R('len', 2)} AS shadow_length_m, {R('w * (h + len) - cut * 12 / 2.0', 2)} AS shadow_area_m2 FROM wide",
            "buildings",
        ),
    ),
    "shadow_on_green": (lambda s, d: _plain(fresh(s, d, "shadow_risk_green")), _s("SELECT * FROM shadows")),
    "shadow_summary": (
        lambda s, d: shadow.shadow_summary(shadow_layer(s, d)),
        _s(
            "SELECT count(*) AS total_shadow_patches, count(*) FILTER (WHERE shadow_risk_level = 'VERY_HIGH') AS very_high_shadow_risk, "
            "count(*) FILTER (WHERE shadow_risk_level = 'HIGH') AS high_shadow_risk, count(*) FILTER (WHERE shadow_risk_level = 'MEDIUM') AS medium_shadow_risk, "
            f"count(*) FILTER (WHERE shadow_risk_level = 'LOW') AS low_shadow_risk, {R('avg(height_m)', 2)} AS avg_height_m, {R('max(height_m)', 2)} AS max_height_m, "
            f"{R('avg(shadow_length_m)', 2)} AS avg_shadow_length_m, {R('max(shadow_length_m)', 2)} AS max_shadow_length_m, "
            f"{R('sum(shadow_on_green_m2)', 2)} AS total_shadow_on_green_m2, {R('avg(shadow_risk_score)', 4)} AS avg_shadow_risk_score, "
            f"{R('max(shadow_risk_score)', 4)} AS max_shadow_risk_score FROM shadows"
        ),
    ),
    "top_k_case_order": (
        lambda s, d: shadow.worst_shadows(shadow_layer(s, d)),
        _s(
            "SELECT source_id, green_id, height_m, shadow_length_m, shadow_on_green_m2, shadow_risk_score, shadow_risk_level, shadow_risk_reason FROM shadows "
            "ORDER BY CASE shadow_risk_level WHEN 'VERY_HIGH' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, shadow_risk_score DESC, source_id, green_id LIMIT 25"
        ),
    ),
    "rule1_spacing": (
        lambda s, d: _plain(rules.rule1_spacing(base_layer(s, d, True))),
        _b(
            "SELECT row_number() OVER (ORDER BY distance_m, building_a_id, building_b_id) AS gid, * FROM ("
            f"SELECT ka AS building_a_id, kb AS building_b_id, 'B' || ka AS building_a_gml_id, 'B' || kb AS building_b_gml_id, {R('d', 2)} AS distance_m, "
            f"{status_sql('d', rules.SPACING, '<')} AS status, '{rules.QUESTION[1]}' AS question FROM close_pairs WHERE d <= 6)", PAIRS,
        ),
    ),
    "rule2_height_ratio": _rule_entry(
        2, rules.rule2_height_ratio, f"height_m, min_face_width_m, {R(RATIO2, 3)} AS height_to_width_ratio", status_sql(RATIO2, rules.HEIGHT_RATIO)
    ),
    "rule3_coverage": _rule_entry(
        3, rules.rule3_coverage, f"footprint_area_m2, bbox_area_m2, {R(RATIO3 + ' * 100', 1)} AS coverage_pct", status_sql(RATIO3, rules.COVERAGE)
    ),
    "rule4_min_height": _rule_entry(4, rules.rule4_min_height, "height_m", status_sql("height_m", rules.MIN_HEIGHT, "<")),
    "rule5_max_height": _rule_entry(5, rules.rule5_max_height, "height_m", status_sql("height_m", rules.MAX_HEIGHT)),
    "rule6_far": _rule_entry(
        6, rules.rule6_far,
        f"height_m, footprint_area_m2, bbox_area_m2, {FLOORS} AS estimated_floors, {R(f'footprint_area_m2 * {FLOORS}', 2)} AS estimated_total_floor_area_m2, {R(RATIO6, 3)} AS far_ratio",
        status_sql(RATIO6, rules.FLOOR_AREA),
    ),
    "combined_rules": (
        lambda s, d: _plain(fresh(s, d, "combined_rules")), _b(f"SELECT *, '{rules.QUESTION[7]}' AS question FROM combined", COMBINED_CTES),
    ),
    "rules_summary": (
        lambda s, d: rules.rules_summary(combined_layer(s, d)),
        _b(
            "SELECT count(*) AS total_buildings, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk, "
            "count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk, count(*) FILTER (WHERE risk_level = 'OK') AS ok_buildings, "
            f"{R('avg(height_m)', 2)} AS avg_height_m, {R('max(height_m)', 2)} AS max_height_m, {R('avg(risk_score)', 2)} AS avg_risk_score FROM combined",
            COMBINED_CTES,
        ),
    ),
    "building_footprints": (
        lambda s, d: _plain(fresh(s, d, "building_footprints")).withColumnRenamed("geometry_id", "sid"),
        _f(f"WITH {FP} SELECT sid, building_id, building_gml_id, ground_elevation, roof_elevation, building_height, footprint_area FROM fp"),
    ),
    "dataset_overview": (
        lambda s, d: rule_report.dataset_overview(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT count(*) AS total_buildings, {R('min(building_height)', 2)} AS min_height_m, {R('max(building_height)', 2)} AS max_height_m, "
            f"{R('avg(building_height)', 2)} AS avg_height_m, {R('min(footprint_area)', 2)} AS min_footprint_m2, {R('max(footprint_area)', 2)} AS max_footprint_m2, "
            f"{R('avg(footprint_area)', 2)} AS avg_footprint_m2 FROM fp"
        ),
    ),
    "setback_pairs": (
        lambda s, d: rule_report.setback_pairs(footprints(s, d)),
        _f(
            f"WITH {FP}, {FP_PAIRS} SELECT ga AS building_a, gb AS building_b, {R('d', 2)} AS distance_meters, "
            f"{status_sql('d', rule_report.SETBACK_TEXT, '<')} AS setback_status FROM fp_pairs WHERE d <= 6"
        ),
    ),
    "setback_counts": (
        lambda s, d: rule_report.setback_counts(footprints(s, d)),
        _f(
            f"WITH {FP}, {FP_PAIRS} SELECT count(*) FILTER (WHERE d < 3) AS critical_pairs, count(*) FILTER (WHERE d < 6) AS warning_pairs FROM fp_pairs WHERE d <= 6"
        ),
    ),
    "height_width_report": (
        lambda s, d: rule_report.height_width_report(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT building_gml_id, {R('building_height', 2)} AS height_m, w AS width_east_west, h AS width_north_south, least(w, h) AS min_face_width_m, "
            f"{R('building_height / nullif(least(w, h), 0)', 3)} AS height_to_width_ratio, CASE WHEN building_height > 1.5 * least(w, h) THEN '{rule_report.HEIGHT_WIDTH_TEXT[0]}' "
            f"WHEN building_height > 1.2 * least(w, h) THEN '{rule_report.HEIGHT_WIDTH_TEXT[1]}' ELSE 'OK' END AS rule_2_status FROM fp"
        ),
    ),
    "height_width_counts": (
        lambda s, d: rule_report.height_width_counts(footprints(s, d)),
        _f(_counts(
            2, "building_height > 1.5 * least(w, h)", "building_height > 1.2 * least(w, h) AND building_height <= 1.5 * least(w, h)",
            "building_height <= 1.2 * least(w, h)",
        )),
    ),
    "bbox_coverage_report": (
        lambda s, d: rule_report.bbox_coverage_report(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT building_gml_id, footprint_area AS footprint_area_m2, w * h AS bbox_area_m2, {R(COVER + ' * 100', 1)} AS coverage_pct, "
            f"{status_sql(COVER, rule_report.COVERAGE_TEXT)} AS rule_3_status FROM fp"
        ),
    ),
    "bbox_coverage_counts": (
        lambda s, d: rule_report.bbox_coverage_counts(footprints(s, d)),
        _f(_counts(3, f"{COVER} > 0.60", f"{COVER} BETWEEN 0.50 AND 0.60", f"{COVER} <= 0.50")),
    ),
    "min_height_report": (
        lambda s, d: rule_report.min_height_report(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT building_gml_id, {R('building_height', 2)} AS height_m, {status_sql('building_height', rule_report.MIN_HEIGHT_TEXT, '<')} AS rule_4_status FROM fp"
        ),
    ),
    "min_height_counts": (
        lambda s, d: rule_report.min_height_counts(footprints(s, d)),
        _f(_counts(4, "building_height < 3", "building_height BETWEEN 3 AND 5", "building_height > 5")),
    ),
    "max_height_report": (
        lambda s, d: rule_report.max_height_report(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT building_gml_id, {R('building_height', 2)} AS height_m, {status_sql('building_height', rule_report.MAX_HEIGHT_TEXT)} AS rule_5_status "
            "FROM fp WHERE building_height > 30"
        ),
    ),
    "max_height_counts": (
        lambda s, d: rule_report.max_height_counts(footprints(s, d)),
        _f(_counts(5, "building_height > 50", "building_height BETWEEN 40 AND 50", "building_height <= 40")),
    ),
    "far_report": (
        lambda s, d: rule_report.far_report(footprints(s, d)),
        _f(
            f"WITH {FP} SELECT building_gml_id, {R('building_height', 2)} AS height_m, footprint_area AS footprint_m2, CAST({FP_FLOORS} AS INTEGER) AS estimated_floors, "
            f"{R(f'footprint_area * {FP_FLOORS}', 2)} AS estimated_total_floor_area_m2, {R(FP_FAR, 3)} AS far_ratio, {status_sql(FP_FAR, rule_report.FAR_TEXT)} AS rule_6_status FROM fp"
        ),
    ),
    "compliance_report": (
        lambda s, d: rule_report.compliance_report(footprints(s, d)),
        _f(
            f"WITH {FP}, {PAIRS} SELECT building_gml_id, {R('building_height', 2)} AS height_m, footprint_area AS footprint_m2, {R('near', 2)} AS nearest_building_m, "
            f"{status_sql('near', [(3, 'FAIL'), (6, 'WARN')], '<')} AS rule1_setback, CASE WHEN building_height > 1.5 * least(w, h) THEN 'FAIL' "
            f"WHEN building_height > 1.2 * least(w, h) THEN 'WARN' ELSE 'OK' END AS rule2_height_ratio, {status_sql(COVER, rules.COVERAGE)} AS rule3_coverage, "
            f"{status_sql('building_height', rules.MIN_HEIGHT, '<')} AS rule4_min_height, {status_sql('building_height', rules.MAX_HEIGHT)} AS rule5_max_height "
            "FROM fp JOIN neighbours n ON n.k = fp.building_id"
        ),
    ),
}
