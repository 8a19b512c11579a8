"""Join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import round_numeric
from urbanframe.operators import advice, materials, spatial_join, store_edit
from urbanframe.operators.footprints import footprint_chain
from urbanframe.plans import occupation, rules
from urbanframe.registry import city, layers, styling
from urbanframe.registry.city import oracle
from urbanframe.registry.layers import R


def _surfaces(s, d):
    r = city.relation(s, d, "surfaces")
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return r.select("sid", G.st_rectangle(x0, y0, x1, y1).alias("sgeom"), G.bbox_struct(x0, y0, x1, y1).alias("sbox"))


def _parcels(s, d):
    return city.parcels(s, d).select(F.col("id").alias("parcel"), F.col("geom").alias("pgeom"), F.col("bbox").alias("pbox"))


def _intersects(s, d):
    j = spatial_join.join_intersects(_surfaces(s, d), _parcels(s, d), "sgeom", "pgeom", "sbox", "pbox")
    return j.select("sid", "parcel")


def _semi(s, d):
    # suppliers' green areas with a customer parcel corner within 120 m
    pts = city.relation(s, d, "parcels").select(F.col("x0").cast("double").alias("px"), F.col("y0").cast("double").alias("py"))
    return spatial_join.semi_dwithin_points(city.greens(s, d), "id", "geom", "bbox", pts, "px", "py", 120.0).select("id")


def _knn(s, d):
    near = spatial_join.nearest(
        _parcels(s, d), city.greens(s, d).select(F.col("id").alias("green_id"), F.col("geom").alias("ggeom"), F.col("bbox").alias("gbox")),
        "parcel", "green_id", "pgeom", "ggeom", "pbox", "gbox",
    )
    return near.select("parcel", "green_id", round_numeric("distance_m", 2).alias("distance_m"))


def _parents(s, d):
    """Features with containment, some parents ended."""
    return city.feature(s, d), city.property_rows(s, d)


GAP = "power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)"

ENTRIES = {
    "footprint_chain": (
        lambda s, d: footprint_chain(
            city.feature(s, d), city.property_rows(s, d), city.dictionary(s, "objectclass"), city.geometry_data(s, d)
        ).select("building_id", "building_gml_id", "surface_id", "geometry_id", "ground_elevation", "roof_elevation", "building_height"),
        oracle(
            "SELECT b.id AS building_id, b.objectid AS building_gml_id, gs.id AS surface_id, g.id AS geometry_id, b.zmin AS ground_elevation, "
            "b.zmax AS roof_elevation, b.zmax - b.zmin AS building_height FROM features b JOIN objectclass ob ON ob.id = b.objectclass_id AND ob.classname = 'Building' "
            "JOIN properties p ON p.feature_id = b.id AND p.name = 'boundary' JOIN features gs ON gs.id = p.val_feature_id "
            "JOIN objectclass og ON og.id = gs.objectclass_id AND og.classname = 'GroundSurface' "
            "JOIN properties q ON q.feature_id = gs.id AND q.val_geometry_id IS NOT NULL JOIN geometries g ON g.id = q.val_geometry_id",
            "features", "properties", "geometries", "objectclass",
        ),
    ),
    "styled_geometry_joins": (
        lambda s, d: materials.geometry_with_class(
            city.geometry_data(s, d), city.feature(s, d), city.dictionary(s, "objectclass"), city.dictionary(s, "namespace")
        ).select("geometry_id", "id", "class", "ns"),
        oracle(
            "SELECT g.id AS geometry_id, f.objectid AS id, o.classname AS class, n.alias AS ns FROM geometries g LEFT JOIN features f ON f.id = g.feature_id "
            "LEFT JOIN objectclass o ON o.id = f.objectclass_id LEFT JOIN namespace n ON n.id = o.namespace_id",
            "geometries", "features", "objectclass", "namespace",
        ),
    ),
    "class_property_joins": (
        lambda s, d: advice.class_property_keys(city.store(s, d)),
        oracle(f"WITH {styling.CLASS_KEYS} SELECT classname, key FROM class_keys", "features", "properties", "geometries", "objectclass", "namespace"),
    ),
    "default_material_join": (
        lambda s, d: city.geometry_data(s, d).select("id").withColumn("material_data", materials.default_material(styling.rules(s))),
        oracle(f"SELECT id, '{styling.DEFAULT_JSON}' AS material_data FROM geometries", "geometries"),
    ),
    "property_value_match": (
        lambda s, d: styling.matches(s, d).select("objectid", "alias", "name", "val_string", "val_int", "val_double"),
        oracle(
            f"SELECT f.objectid, n.alias, p.name, p.val_string, p.val_int, p.val_double FROM properties p JOIN features f ON f.id = p.feature_id "
            f"JOIN namespace n ON n.id = p.namespace_id JOIN ({styling.PROPERTY_RULES_SQL}) r ON r.property_name = p.name AND r.namespace_of_property = n.alias "
            "WHERE f.objectclass_id = 901 AND (p.val_string = r.property_value OR CAST(p.val_int AS VARCHAR) = r.property_value OR "
            "CASE WHEN p.val_double = floor(p.val_double) THEN CAST(CAST(p.val_double AS BIGINT) AS VARCHAR) ELSE CAST(p.val_double AS VARCHAR) END = r.property_value)",
            "features", "properties", "namespace",
        ),
    ),
    "surface_material_join": (
        lambda s, d: materials.surface_materials(city.geometry_data(s, d), city.store_table(s, d, "surface_data_mapping"), city.store_table(s, d, "surface_data")).select(
            F.col("id").alias("geometry_id"), "surface", "surface_data_id", "x3d_diffuse_color"
        ),
        oracle(
            f"WITH {styling.SURFACE_CTE} SELECT geometry_id, surface, surface_data_id, x3d_diffuse_color FROM surface_rows",
            "geometries", "surface_mappings", "surface_datas",
        ),
    ),
    "spatial_intersects_join": (
        _intersects,
        oracle("SELECT a.sid, b.id AS parcel FROM surfaces a JOIN parcels b ON a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.y1 >= b.y0 AND a.y0 <= b.y1", "surfaces", "parcels"),
    ),
    "spatial_dwithin_semi": (
        _semi,
        oracle(
            "SELECT id FROM greens g WHERE EXISTS (SELECT 1 FROM parcels p WHERE power(greatest(0, g.x0 - p.x0, p.x0 - g.x1), 2) + "
            "power(greatest(0, g.y0 - p.y0, p.y0 - g.y1), 2) <= 14400)", "greens", "parcels",
        ),
    ),
    "spatial_dwithin_pairs": (
        lambda s, d: spatial_join.pairs_within(_surfaces(s, d), "sid", "sgeom", "sbox", 6.0).select(
            "a_sid", "b_sid", round_numeric("distance_m", 3).alias("distance_m")
        ),
        oracle(f"SELECT a.sid AS a_sid, b.sid AS b_sid, {R(f'sqrt({GAP})', 3)} AS distance_m FROM surfaces a JOIN surfaces b ON b.sid > a.sid WHERE {GAP} <= 36", "surfaces"),
    ),
    "knn_join": (
        _knn,
        oracle(
            f"SELECT parcel, green_id, {R('sqrt(d)', 2)} AS distance_m FROM (SELECT a.id AS parcel, b.id AS green_id, {GAP} AS d, "
            f"row_number() OVER (PARTITION BY a.id ORDER BY {GAP}, b.id) AS rn FROM parcels a, greens b) WHERE rn = 1", "parcels", "greens",
        ),
    ),
    "nearest_neighbor_distance": (
        lambda s, d: rules.nearest_building(layers.base_layer(s, d)).select("building_id", round_numeric("nearest_building_m", 2).alias("nearest_building_m")),
        oracle(f"WITH {layers.PAIRS} SELECT k AS building_id, {R('near', 2)} AS nearest_building_m FROM neighbours", "surfaces"),
    ),
    "model_area_join": (
        lambda s, d: occupation.parcels_clean(
            city.parcels(s, d), _surfaces(s, d).select(F.col("sbox").alias("bbox"))
        ).select("parcel_id", G.st_area("geom").alias("area")),
        layers._p("SELECT parcel_id, area FROM clean_parcels"),
    ),
    "parcel_left_coverage": (
        lambda s, d: layers.fos_layer(s, d).select("parcel_id", "buildings_count", "occupied_area_m2", "fos_pct"),
        layers._p("SELECT parcel_id, buildings_count, occupied_area_m2, fos_pct FROM fos", layers.FOS_CTES),
    ),
    "orphan_anti": (
        # surface data no appearance uses once theme0 is gone
        lambda s, d: store_edit.orphans(
            city.store_table(s, d, "surface_data").select("id"),
            city.store_table(s, d, "appear_to_surface_data").join(
                city.store_table(s, d, "appearance").where("theme = 'theme0'").select(F.col("id").alias("appearance_id")), "appearance_id", "left_anti"
            ), "surface_data_id",
        ),
        oracle(
            "SELECT id FROM surface_datas WHERE id NOT IN (SELECT l.surface_data_id FROM appearance_links l JOIN appearances a ON a.id = l.appearance_id WHERE a.theme <> 'theme0')",
            "surface_datas", "appearance_links", "appearances",
        ),
    ),
    "not_exists_active_parent": (
        lambda s, d: store_edit.without_active_parent(
            city.property_rows(s, d).where("val_relation_type = 1").select(F.col("val_feature_id").alias("id")).distinct(), city.property_rows(s, d), city.feature(s, d)
        ),
        oracle(
            "SELECT DISTINCT p.val_feature_id AS id FROM properties p WHERE p.val_relation_type = 1 AND NOT EXISTS (SELECT 1 FROM properties q JOIN features f ON f.id = q.feature_id "
            "WHERE q.val_feature_id = p.val_feature_id AND q.val_relation_type = 1 AND f.termination_date IS NULL)", "properties", "features",
        ),
    ),
    "property_parent_join": (
        lambda s, d: store_edit.same_named_parents(city.property_rows(s, d), city.property_rows(s, d).select("id")),
        oracle(
            "SELECT c.id, p.id AS parent_id FROM properties c JOIN properties p ON p.id = c.parent_id AND p.name = c.name AND p.namespace_id = c.namespace_id", "properties",
        ),
    ),
}
