"""Store maintenance: envelopes, deletes, terminations, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.operators import envelopes, report, store_edit
from urbanframe.registry import city
from urbanframe.registry.city import ARM, INSTALL, NESTED, SURFACE, oracle

HEIGHT = "((z + height_m) - z)"
TABLES = (
    "address", "appear_to_surface_data", "appearance", "feature", "geometry_data", "implicit_geometry", "property", "surface_data",
    "surface_data_mapping", "tex_image",
)


def _low(s, d, limit=12.0):
    """Buildings below a height."""
    return city.feature(s, d).where((F.col("objectclass_id") == 901) & (G.st_height("envelope") < limit)).select("id")


def _left(store):
    """Remaining rows: table and key."""
    out = None
    for t in TABLES:
        df = store[t]
        key = F.col("geometry_data_id") if t == "surface_data_mapping" else F.col("id")
        part = df.select(F.lit(t).alias("tab"), key.alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def _envelope_cols(df, *keys):
    b = G.st_bbox("envelope")
    return df.withColumn("_b", b).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")])


def _z(g):
    pts = G.points_of(g)
    return [F.transform(pts, lambda p: p["z"])[i].alias(f"z{i}") for i in range(4)]


ALL = (
    "surfaces", "features", "properties", "geometries", "templates", "appearances", "appearance_links", "surface_datas",
    "surface_mappings", "textures", "addresses",
)

# ---- oracle of the cascade on the derived model -----------------------------
# A building takes its surfaces, address and appearance along. An installation goes with its last containing
# building, or when a plain reference remains; its nested part follows.
GONE = f"""gone_b AS (SELECT k FROM buildings WHERE (z + height_m) - z < {{limit}}),
held AS (
  SELECT b.k, b.k IN (SELECT k FROM gone_b) AS owner_gone, b.k % 20 = 13 AS shared, b.k % 20 = 3 AS mentioned,
         b.k + 1 IN (SELECT k FROM gone_b) AS next_gone, EXISTS (SELECT 1 FROM buildings n WHERE n.k = b.k + 1) AS has_next
  FROM buildings b WHERE b.k % 10 = 3),
gone_i AS (
  SELECT k FROM held WHERE CASE
    WHEN shared AND has_next THEN owner_gone AND next_gone
    ELSE owner_gone END),
gone_f AS (
  SELECT k AS id FROM gone_b UNION ALL SELECT sid FROM surfaces WHERE k IN (SELECT k FROM gone_b)
  UNION ALL SELECT k + {INSTALL} FROM gone_i UNION ALL SELECT k + {NESTED} FROM gone_i),
gone_p AS (
  SELECT id FROM properties WHERE feature_id IN (SELECT id FROM gone_f) OR val_feature_id IN (SELECT id FROM gone_f)),
left_p AS (SELECT * FROM properties WHERE id NOT IN (SELECT id FROM gone_p)),
gone_t AS (
  SELECT t.id, t.relative_geometry_id FROM templates t
  WHERE t.id IN (SELECT p.val_implicitgeom_id FROM properties p JOIN gone_p g ON g.id = p.id)
    AND t.id NOT IN (SELECT val_implicitgeom_id FROM left_p WHERE val_implicitgeom_id IS NOT NULL)),
gone_g AS (
  SELECT p.val_geometry_id AS id FROM properties p JOIN gone_p g ON g.id = p.id WHERE p.val_geometry_id IS NOT NULL
  UNION ALL SELECT relative_geometry_id FROM gone_t WHERE relative_geometry_id IS NOT NULL),
gone_a AS (SELECT k AS id FROM gone_b WHERE k % 3 = 0),
left_l AS (SELECT * FROM appearance_links WHERE appearance_id NOT IN (SELECT id FROM gone_a)),
gone_s AS (
  SELECT DISTINCT surface_data_id AS id FROM appearance_links WHERE appearance_id IN (SELECT id FROM gone_a)
    AND surface_data_id NOT IN (SELECT surface_data_id FROM left_l)),
left_s AS (SELECT * FROM surface_datas WHERE id NOT IN (SELECT id FROM gone_s)),
gone_x AS (
  SELECT DISTINCT tex_image_id AS id FROM surface_datas WHERE id IN (SELECT id FROM gone_s) AND tex_image_id IS NOT NULL
    AND tex_image_id NOT IN (SELECT tex_image_id FROM left_s WHERE tex_image_id IS NOT NULL))"""
REMAINING = """
SELECT 'feature' AS tab, id FROM features WHERE id NOT IN (SELECT id FROM gone_f)
UNION ALL SELECT 'property', id FROM left_p
UNION ALL SELECT 'geometry_data', id FROM geometries WHERE id NOT IN (SELECT id FROM gone_g)
UNION ALL SELECT 'implicit_geometry', id FROM templates WHERE id NOT IN (SELECT id FROM gone_t)
UNION ALL SELECT 'address', id FROM addresses WHERE id NOT IN (SELECT k FROM gone_b)
UNION ALL SELECT 'appearance', id FROM appearances WHERE id NOT IN (SELECT id FROM gone_a)
UNION ALL SELECT 'appear_to_surface_data', id FROM left_l WHERE surface_data_id NOT IN (SELECT id FROM gone_s)
UNION ALL SELECT 'surface_data', id FROM left_s
UNION ALL SELECT 'tex_image', id FROM textures WHERE id NOT IN (SELECT id FROM gone_x)
UNION ALL SELECT 'surface_data_mapping', geometry_data_id FROM surface_mappings
  WHERE geometry_data_id NOT IN (SELECT id FROM gone_g) AND surface_data_id NOT IN (SELECT id FROM gone_s)
"""


def _cascade_sql(limit):
    return oracle(f"WITH {GONE.format(limit=limit)} {REMAINING}", *ALL)


def _simple(table, pick, tables):
    """Delete by a condition on the table, show what is left of the tables it touches."""

    def run(s, d):
        st = city.store(s, d)
        after, _ = store_edit.delete_simple(st, table, st[table].where(pick).select("id"))
        out = None
        for t in tables:
            key = "geometry_data_id" if t == "surface_data_mapping" else "id"
            part = after[t].select(F.lit(t).alias("tab"), F.col(key).alias("id"))
            out = part if out is None else out.unionByName(part)
        return out

    return run


def _terminate(s, d):
    st = city.store(s, d)
    meta = {"termination_date": "2024-05-06 07:08:09", "last_modification_date": "2024-05-06 00:00:00", "reason_for_update": "demolished", "updating_person": "clerk"}
    after, _ = store_edit.terminate_features(st, _low(s, d, 30.0), meta)
    return after["feature"].where("termination_date = timestamp '2024-05-06 07:08:09'").select(
        "id", "reason_for_update", "updating_person", F.col("last_modification_date").cast("string").alias("modified")
    )


def _delete_props(s, d):
    st = city.store(s, d)
    ids = st["property"].where("name = 'height' or (name = 'energyClass' and parent_id is not null)").select("id")
    after, _ = store_edit.delete_properties(st, ids)
    return after["property"].select("id")


def _delete_props_ids(s, d):
    st = city.store(s, d)
    ids = st["property"].where("name = 'height' or (name = 'energyClass' and parent_id is not null)").select("id")
    return store_edit.delete_properties(st, ids)[1]


def _env(compute):
    return lambda s, d: _envelope_cols(envelopes.feature_envelopes(city.store(s, d), compute=compute), "id")


# Template uses: box through the matrix (2x, +1/+2/+3) or only shifted; reference point alone without a template shape.
USES = f"""uses AS (
  SELECT p.id AS property_id, p.feature_id, CASE WHEN p.val_array IS NULL THEN 1 ELSE 2 END AS sx,
         p.refx + CASE WHEN p.val_array IS NULL THEN 0 ELSE 1 END AS ox, p.refy + CASE WHEN p.val_array IS NULL THEN 0 ELSE 2 END AS oy,
         p.refz + CASE WHEN p.val_array IS NULL THEN 0 ELSE 3 END AS oz, coalesce(g.tx1, 0) AS tx, coalesce(g.ty1, 0) AS ty
  FROM properties p LEFT JOIN templates t ON t.id = p.val_implicitgeom_id LEFT JOIN geometries g ON g.id = t.relative_geometry_id
  WHERE p.val_implicitgeom_id IS NOT NULL),
implicit_boxes AS (
  SELECT property_id, feature_id, ox AS xmin, oy AS ymin, oz AS zmin, ox + sx * tx AS xmax, oy + ty AS ymax, oz AS zmax FROM uses)"""
OWN = f"""{USES}, own AS (
  SELECT feature_id AS id, gx0 AS xmin, gy0 AS ymin, gz AS zmin, gx1 AS xmax, gy1 AS ymax, gz AS zmax FROM geometries WHERE gx0 IS NOT NULL
  UNION ALL SELECT feature_id, xmin, ymin, zmin, xmax, ymax, zmax FROM implicit_boxes)"""
_BOX = ", ".join(f"min({c}min) AS {c}min" for c in "xyz") + ", " + ", ".join(f"max({c}max) AS {c}max" for c in "xyz")


def _reach_sql(body, root_filter):
    return oracle(
        f"WITH RECURSIVE {OWN}, reach AS (SELECT id AS root, id FROM features UNION SELECT r.root, p.val_feature_id FROM reach r JOIN properties p ON p.feature_id = r.id "
        f"WHERE p.val_relation_type = 1 {root_filter}) {body}", "features", "properties", "templates", "geometries",
    )


REPORT_SQL = """
SELECT 'featureCount' AS section, '' AS name, count(*) FILTER (WHERE termination_date IS NULL) AS active, count(*) FILTER (WHERE termination_date IS NOT NULL) AS terminated FROM features
UNION ALL SELECT 'topLevelFeatureCount', '', count(*) FILTER (WHERE termination_date IS NULL), count(*) FILTER (WHERE termination_date IS NOT NULL)
  FROM features f JOIN objectclass o ON o.id = f.objectclass_id WHERE o.is_toplevel = 1
UNION ALL SELECT 'byType', n.alias || ':' || o.classname, count(*) FILTER (WHERE termination_date IS NULL), count(*) FILTER (WHERE termination_date IS NOT NULL)
  FROM features f JOIN objectclass o ON o.id = f.objectclass_id JOIN namespace n ON n.id = o.namespace_id GROUP BY 2
UNION ALL SELECT 'geometryCount', '', count(*), 0 FROM live_geometries
UNION ALL SELECT 'geometryByType', 'Solid', count(*), 0 FROM live_geometries
UNION ALL SELECT 'geometryByLod', p.val_lod, count(*), 0 FROM properties p JOIN features f ON f.id = p.feature_id WHERE f.termination_date IS NULL AND p.val_lod IS NOT NULL GROUP BY 2
UNION ALL SELECT 'implicitGeometryCount', '', count(*), 0 FROM templates
UNION ALL SELECT 'addressCount', '', count(*), 0 FROM addresses
UNION ALL SELECT 'appearanceCount', '', count(*), 0 FROM appearances
UNION ALL SELECT 'appearanceByTheme', theme, count(*), 0 FROM appearances GROUP BY 2
UNION ALL SELECT 'globalAppearances', '', count(*), 0 FROM appearances WHERE is_global = 1
UNION ALL SELECT 'materialMappings', '', count(*), 0 FROM surface_mappings
UNION ALL SELECT 'textureMappings', '', count(*), 0 FROM surface_mappings WHERE texture_mapping IS NOT NULL
UNION ALL SELECT 'georeferencedMappings', '', 0, 0
UNION ALL SELECT 'genericAttributes', p.name || '/' || t.typename, count(*), 0 FROM properties p JOIN datatype t ON t.id = p.datatype_id WHERE p.namespace_id = 3 GROUP BY 2
UNION ALL SELECT 'topLevelFeatures', n.alias || ':' || o.classname, count(*), 0
  FROM features f JOIN objectclass o ON o.id = f.objectclass_id JOIN namespace n ON n.id = o.namespace_id WHERE o.is_toplevel = 1 AND f.termination_date IS NULL GROUP BY 2
UNION ALL SELECT 'lods', p.val_lod, count(*), 0 FROM properties p JOIN features f ON f.id = p.feature_id WHERE f.termination_date IS NULL AND p.val_lod IS NOT NULL GROUP BY 2
UNION ALL SELECT 'themes', theme, count(*), 0 FROM appearances WHERE theme IS NOT NULL GROUP BY 2
UNION ALL SELECT 'modules', n.alias || '=urn:' || n.alias, count(*), 0
  FROM features f JOIN objectclass o ON o.id = f.objectclass_id JOIN namespace n ON n.id = o.namespace_id WHERE f.termination_date IS NULL GROUP BY 2
UNION ALL SELECT 'codeLists', c.kind || '=codes/' || c.n_nationkey, coalesce(e.n, 0), 0
  FROM (SELECT *, CASE n_regionkey % 2 WHEN 0 THEN 'bldg:class' ELSE 'bldg:roofType' END AS kind FROM nation) c
  LEFT JOIN (SELECT p_size % 25 AS id, count(*) AS n FROM part GROUP BY 1) e ON e.id = c.n_nationkey
"""


def _report_store(s, d):
    """The store with addresses of its modules, code lists by nation and their entries by part."""
    kind = F.when(F.col("n_regionkey") % 2 == 0, "bldg:class").otherwise("bldg:roofType")
    lists = city.table(s, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), kind.alias("codelist_type"), F.concat(F.lit("codes/"), F.col("n_nationkey").cast("string")).alias("url")
    )
    entries = city.table(s, d, "part").select(
        F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") % 25).cast("long").alias("codelist_id"), F.col("p_type").alias("code")
    )
    store = city.store(s, d)
    modules = store["namespace"].withColumn("namespace", F.concat(F.lit("urn:"), "alias"))
    return {**store, "namespace": modules, "codelist": lists, "codelist_entry": entries}

ENTRIES = {
    "geometry_envelope": (
        lambda s, d: city.class_geometries(s, d).select("id", *_z(envelopes.geometry_envelope("geom"))),
        oracle("SELECT objectid AS id, zmin AS z0, zmin AS z1, zmax AS z2, zmax AS z3 FROM features WHERE xmin IS NOT NULL", "features"),
    ),
    "implicit_envelope": (
        lambda s, d: _envelope_cols(
            envelopes.implicit_envelopes(city.property_rows(s, d), city.store_table(s, d, "implicit_geometry"), city.geometry_data(s, d)), "property_id", "feature_id"
        ),
        oracle(f"WITH {USES} SELECT * FROM implicit_boxes", "properties", "templates", "geometries"),
    ),
    "feature_envelope": (
        _env(False),
        _reach_sql(
            f"SELECT f.id, CASE WHEN f.xmin IS NOT NULL THEN f.xmin ELSE c.xmin END AS xmin, CASE WHEN f.xmin IS NOT NULL THEN f.ymin ELSE c.ymin END AS ymin, "
            "CASE WHEN f.xmin IS NOT NULL THEN f.zmin ELSE c.zmin END AS zmin, CASE WHEN f.xmin IS NOT NULL THEN f.xmax ELSE c.xmax END AS xmax, "
            "CASE WHEN f.xmin IS NOT NULL THEN f.ymax ELSE c.ymax END AS ymax, CASE WHEN f.xmin IS NOT NULL THEN f.zmax ELSE c.zmax END AS zmax "
            f"FROM features f LEFT JOIN (SELECT r.root, {_BOX} FROM reach r JOIN own ON own.id = r.id GROUP BY r.root) c ON c.root = f.id", "",
        ),
    ),
    "feature_envelope_computed": (
        _env(True),
        _reach_sql(f"SELECT r.root AS id, {_BOX} FROM reach r JOIN own ON own.id = r.id GROUP BY r.root", ""),
    ),
    "feature_envelope_write_back": (
        lambda s, d: envelopes.write_back_envelopes(
            city.feature(s, d), envelopes.feature_envelopes(city.store(s, d), city.feature(s, d).where("envelope is null").select("id"))
        ).select("id", G.st_bbox("envelope")["xmin"].alias("xmin")),
        _reach_sql(f"SELECT f.id, coalesce(f.xmin, c.xmin) AS xmin FROM features f LEFT JOIN (SELECT r.root, {_BOX} FROM reach r JOIN own ON own.id = r.id GROUP BY r.root) c ON c.root = f.id", ""),
    ),
    "delete_features": (lambda s, d: _left(store_edit.delete_features(city.store(s, d), _low(s, d))[0]), _cascade_sql(12)),
    "delete_features_ids": (
        lambda s, d: store_edit.delete_features(city.store(s, d), _low(s, d))[1],
        oracle("SELECT k AS id FROM buildings WHERE (z + height_m) - z < 12", "buildings"),
    ),
    "delete_by_class": (lambda s, d: _left(store_edit.delete_by_class(city.store(s, d), "Building")[0]), _cascade_sql(1000)),
    "delete_properties": (
        _delete_props, oracle("SELECT id FROM properties WHERE name NOT IN ('height', 'status', 'energyClass')", "properties"),
    ),
    "delete_properties_ids": (
        _delete_props_ids, oracle("SELECT id FROM properties WHERE name = 'height' OR (name = 'energyClass' AND parent_id IS NOT NULL)", "properties"),
    ),
    "delete_geometries": (
        _simple("geometry_data", f"feature_id >= {ARM} and feature_id < {INSTALL}", ("geometry_data", "property")),
        oracle(
            f"SELECT 'geometry_data' AS tab, id FROM geometries WHERE NOT coalesce(feature_id >= {ARM} AND feature_id < {INSTALL}, false) "
            f"UNION ALL SELECT 'property', id FROM properties WHERE NOT coalesce(val_geometry_id >= {ARM} AND val_geometry_id < {INSTALL}, false)", "geometries", "properties",
        ),
    ),
    "delete_implicit_geometries": (
        _simple("implicit_geometry", "relative_geometry_id is not null", ("implicit_geometry", "geometry_data", "property")),
        oracle(
            "SELECT 'implicit_geometry' AS tab, id FROM templates WHERE relative_geometry_id IS NULL UNION ALL "
            "SELECT 'geometry_data', id FROM geometries WHERE id NOT IN (SELECT relative_geometry_id FROM templates WHERE relative_geometry_id IS NOT NULL) UNION ALL "
            "SELECT 'property', id FROM properties WHERE val_implicitgeom_id IS NULL OR val_implicitgeom_id IN (SELECT id FROM templates WHERE relative_geometry_id IS NULL)",
            "templates", "geometries", "properties",
        ),
    ),
    "delete_appearances": (
        _simple("appearance", "theme = 'theme1'", ("appearance", "appear_to_surface_data", "surface_data", "tex_image")),
        oracle(
            "WITH keep AS (SELECT id FROM appearances WHERE theme <> 'theme1'), keep_l AS (SELECT * FROM appearance_links WHERE appearance_id IN (SELECT id FROM keep)), "
            "keep_s AS (SELECT * FROM surface_datas WHERE id IN (SELECT surface_data_id FROM keep_l) OR id NOT IN (SELECT surface_data_id FROM appearance_links)) "
            "SELECT 'appearance' AS tab, id FROM keep UNION ALL SELECT 'appear_to_surface_data', id FROM keep_l UNION ALL SELECT 'surface_data', id FROM keep_s UNION ALL "
            "SELECT 'tex_image', id FROM textures WHERE id IN (SELECT tex_image_id FROM keep_s) OR id NOT IN (SELECT tex_image_id FROM surface_datas WHERE tex_image_id IS NOT NULL)",
            "appearances", "appearance_links", "surface_datas", "textures",
        ),
    ),
    "delete_surface_data": (
        _simple("surface_data", "x3d_diffuse_color is null", ("surface_data", "tex_image", "appear_to_surface_data", "surface_data_mapping")),
        oracle(
            "WITH keep_s AS (SELECT * FROM surface_datas WHERE x3d_diffuse_color IS NOT NULL) SELECT 'surface_data' AS tab, id FROM keep_s UNION ALL "
            "SELECT 'tex_image', id FROM textures WHERE id IN (SELECT tex_image_id FROM keep_s) OR id NOT IN (SELECT tex_image_id FROM surface_datas WHERE tex_image_id IS NOT NULL) UNION ALL "
            "SELECT 'appear_to_surface_data', id FROM appearance_links WHERE surface_data_id NOT IN (SELECT id FROM surface_datas WHERE x3d_diffuse_color IS NULL) UNION ALL "
            "SELECT 'surface_data_mapping', geometry_data_id FROM surface_mappings WHERE surface_data_id IN (SELECT id FROM keep_s)",
            "surface_datas", "textures", "appearance_links", "surface_mappings",
        ),
    ),
    "delete_tex_images": (
        _simple("tex_image", "image_uri like 'tex1%'", ("tex_image",)),
        oracle("SELECT 'tex_image' AS tab, id FROM textures WHERE image_uri NOT LIKE 'tex1%'", "textures"),
    ),
    "delete_addresses": (
        _simple("address", "street = 'Street 5'", ("address", "property")),
        oracle(
            "SELECT 'address' AS tab, id FROM addresses WHERE street <> 'Street 5' UNION ALL SELECT 'property', id FROM properties "
            "WHERE val_address_id IS NULL OR val_address_id NOT IN (SELECT id FROM addresses WHERE street = 'Street 5')", "addresses", "properties",
        ),
    ),
    "terminate_features": (
        _terminate,
        oracle(
            f"WITH ended AS (SELECT k FROM buildings WHERE {HEIGHT} < 30), "
            "active AS (SELECT k FROM buildings WHERE k % 11 <> 5 AND k NOT IN (SELECT k FROM ended)), "
            # an installation follows if a containing building ended now and none is still active
            "gone AS (SELECT k FROM buildings b WHERE k % 10 = 3 AND (k IN (SELECT k FROM ended) OR (k % 20 = 13 AND k + 1 IN (SELECT k FROM ended))) "
            "AND k NOT IN (SELECT k FROM active) AND NOT (k % 20 = 13 AND k + 1 IN (SELECT k FROM active))), "
            "done AS (SELECT k AS id FROM ended UNION ALL SELECT sid FROM surfaces WHERE k IN (SELECT k FROM ended) "
            f"UNION ALL SELECT k + {INSTALL} FROM gone UNION ALL SELECT k + {NESTED} FROM gone) "
            "SELECT id, 'demolished' AS reason_for_update, 'clerk' AS updating_person, '2024-05-06 00:00:00' AS modified FROM done", "surfaces",
        ),
    ),
    "cleanup_store": (
        lambda s, d: _left(store_edit.cleanup_store(city.store(s, d))).unionByName(
            store_edit.cleanup_store({**city.store(s, d), "codelist": city.table(s, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id")})["codelist"].select(F.lit("codelist").alias("tab"), "id")
        ),
        "SELECT 'codelist' AS tab, CAST(n_nationkey AS BIGINT) AS id FROM nation",
    ),
    "city_report": (
        lambda s, d: report.city_report(_report_store(s, d)),
        oracle(
            "WITH live_geometries AS (SELECT g.id FROM geometries g JOIN features f ON f.id = g.feature_id WHERE f.termination_date IS NULL AND g.gx0 IS NOT NULL) " + REPORT_SQL,
            *ALL, "objectclass", "namespace", "datatype",
        ),
    ),
    "city_report_json": (lambda s, d: report.city_report_json(_report_store(s, d)), None),
}
