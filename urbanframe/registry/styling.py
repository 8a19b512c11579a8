"""Materials, styled geometries, advice, tiles and the change log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import round_numeric
from urbanframe.operators import advice, materials, tiles
from urbanframe.registry import city
from urbanframe.registry.city import oracle
from urbanframe.session import checkpoint_dir, cut_lineage
from urbanframe.streaming import changelog

# Rules of the derived model: the fallback, one per class, three for roof types, one number match.
_SPARE = (None,) * 4
RULES = [
    (None, "anything_else", *_SPARE, None, "#ffff00ff", "#000000", None, None),
    ("bldg", "Building", *_SPARE, None, "#999999ff", "#000000", None, None),
    ("bldg", "BuildingInstallation", *_SPARE, "#010101", "#647a7aff", None, None, "#0a0a0a"),
    ("bldg", "Building", "bldg", "roofType", "val_string", "STANDARD", None, "#aa0000ff", "#000000", None, None),
    ("bldg", "Building", "bldg", "roofType", "val_string", "PROMO", "#0f0f0f", "#00aa00ff", "#000000", "#cccccc", None),
    ("bldg", "Building", "bldg", "roofType", "val_string", "LARGE", None, "#0000aaff", None, None, None),
    ("bldg", "Building", "bldg", "storeys", "val_int", "7", None, "#123456ff", None, None, None),
    ("bldg", "Building", "con", "height", "val_double", "12", None, "#654321ff", None, None, None),
]
_MATCH = {"STANDARD": 3, "PROMO": 4, "LARGE": 5}
CLASS_JSON = {
    "Building": '{"PbrMetallicRoughness":{"BaseColors":["#999999ff"],"MetallicRoughness":["#000000"]}}',
    "BuildingInstallation": '{"EmissiveColors":["#010101"],"PbrMetallicRoughness":{"BaseColors":["#647a7aff"]},"SpecularGlossiness":{"SpecularGlossiness":["#0a0a0a"]}}',
}
DEFAULT_JSON = '{"PbrMetallicRoughness":{"BaseColors":["#ffff00ff"],"MetallicRoughness":["#000000"]}}'
PROPERTY_JSON = {
    "STANDARD": '{"PbrMetallicRoughness":{"BaseColors":["#aa0000ff"],"MetallicRoughness":["#000000"]}}',
    "PROMO": '{"EmissiveColors":"#0f0f0f","PbrMetallicRoughness":{"BaseColors":["#00aa00ff"],"MetallicRoughness":["#000000"]},"SpecularGlossiness":{"DiffuseColors":["#cccccc"]}}',
    "LARGE": '{"PbrMetallicRoughness":{"BaseColors":["#0000aaff"]}}',
    "7": '{"PbrMetallicRoughness":{"BaseColors":["#123456ff"]}}',
    "12": '{"PbrMetallicRoughness":{"BaseColors":["#654321ff"]}}',
}
PROPERTY_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r[2]}', '{r[3]}', '{r[5]}', '{PROPERTY_JSON[r[5]]}')" for r in RULES if r[5]
) + ") AS v(namespace_of_property, property_name, property_value, material_data)"


def rules(spark):
    ddl = ", ".join(f"{c} string" for c in materials.RULE_COLUMNS)
    return spark.createDataFrame(RULES, ddl)


def rules_per_brand(spark, sf):
    """Every rule once per brand of the part table (the namespace carries the brand)."""
    brands = city.table(spark, sf, "part").select("p_brand").distinct()
    r = rules(spark)
    return brands.join(r, F.lit(True)).withColumn("namespace_of_classname", F.concat_ws("/", "p_brand", "namespace_of_classname")).drop("p_brand")


def matches(s, d):
    return materials.material_property_match(
        city.feature(s, d), city.property_rows(s, d), city.dictionary(s, "objectclass"), city.dictionary(s, "namespace"), rules(s)
    )


def appearance_materials(s, d):
    return materials.material_from_appearance(
        city.feature(s, d), city.geometry_data(s, d), city.store_table(s, d, "surface_data_mapping"), city.store_table(s, d, "surface_data"), rules(s)
    )


def styled(mode, absence, **kw):
    return lambda s, d: materials.styled_geometries(city.store(s, d), rules(s), mode, absence, **kw).select("geometry_id", "id", "class", "ns", "material_data")


# ---------------------------------------------------------------- oracle pieces
# Mapped surfaces: row m names S(6m) and S(6m+1).
SURFACE_CTE = """mapped AS (
  SELECT surface_data_id, texture_mapping, 'S' || (geometry_data_id - 1000000000 + off) AS surface FROM surface_mappings, (VALUES (0), (1)) AS o(off)),
surface_rows AS (
  SELECT g.id AS geometry_id, g.feature_id, g.surface, m.surface_data_id, sd.x3d_diffuse_color, sd.x3d_shininess, sd.x3d_ambient_intensity,
         sd.x3d_emissive_color, sd.x3d_specular_color
  FROM geometries g LEFT JOIN mapped m ON m.surface = g.surface LEFT JOIN surface_datas sd ON sd.id = m.surface_data_id
  WHERE g.surface IS NOT NULL AND m.texture_mapping IS NULL)"""


def _hex(v):
    return f"lower(to_hex(CAST(round({v} * 256, 0) AS BIGINT)))"


ROUGH = (
    "CASE WHEN x3d_diffuse_color IS NULL OR coalesce(x3d_shininess, x3d_ambient_intensity) IS NULL THEN '#000000' "
    f"ELSE '#' || coalesce({_hex('x3d_shininess')}, '00') || coalesce({_hex('x3d_ambient_intensity')}, '00') || '00' END"
)


def _list(expr):
    return f"string_agg('\"' || {expr} || '\"', ',' ORDER BY {expr})"


APPEARANCE_CTE = f"""{SURFACE_CTE}, appearance_materials AS (
  SELECT f.objectid, '{{' || coalesce('"EmissiveColors":[' || {_list('x3d_emissive_color')} || '],', '')
         || '"PbrMetallicRoughness":{{"BaseColors":[' || {_list("coalesce(x3d_diffuse_color, '#333333')")} || '],"MetallicRoughness":[' || {_list(f'({ROUGH})')} || ']}}'
         || coalesce(',"SpecularGlossiness":{{"SpecularGlossiness":[' || {_list('x3d_specular_color')} || ']}}', '') || '}}' AS material_data
  FROM surface_rows r LEFT JOIN features f ON f.id = r.feature_id GROUP BY f.objectid)""".replace("{{", "{").replace("}}", "}")
MATCH_CTE = f"""property_materials AS (
  SELECT f.objectid, p.name, n.alias, p.val_string, p.val_int, p.val_double, r.material_data
  FROM properties p JOIN features f ON f.id = p.feature_id JOIN namespace n ON n.id = p.namespace_id
  JOIN ({PROPERTY_RULES_SQL}) r ON r.property_name = p.name AND r.namespace_of_property = n.alias
  WHERE f.objectclass_id = 901 AND (p.val_string = r.property_value OR CAST(p.val_int AS VARCHAR) = r.property_value
    OR CASE WHEN p.val_double = floor(p.val_double) THEN CAST(CAST(p.val_double AS BIGINT) AS VARCHAR) ELSE CAST(p.val_double AS VARCHAR) END = r.property_value)),
best_match AS (SELECT objectid, min(material_data) AS material_data FROM property_materials GROUP BY objectid)"""
_CLASS = "CASE o.classname " + " ".join(f"WHEN '{c}' THEN '{j}'" for c, j in CLASS_JSON.items()) + " END"
STYLE_PARTS = {"default": f"'{DEFAULT_JSON}'", "class": _CLASS, "property": "pm.material_data", "appearance": "am.material_data"}


def styled_sql(sources, extra=""):
    return oracle(
        f"WITH {APPEARANCE_CTE}, {MATCH_CTE} SELECT g.id AS geometry_id, f.objectid AS id, o.classname AS class, n.alias AS ns, "
        f"coalesce({', '.join(STYLE_PARTS[x] for x in sources)}, NULL) AS material_data FROM geometries g LEFT JOIN features f ON f.id = g.feature_id "
        "LEFT JOIN objectclass o ON o.id = f.objectclass_id LEFT JOIN namespace n ON n.id = o.namespace_id "
        "LEFT JOIN best_match pm ON pm.objectid = f.objectid LEFT JOIN appearance_materials am ON am.objectid = f.objectid "
        f"WHERE g.gx0 IS NOT NULL {extra}",
        "geometries", "features", "properties", "surface_mappings", "surface_datas", "objectclass", "namespace",
    )


CLASS_KEYS = """class_keys AS (
  SELECT DISTINCT o.classname, CASE WHEN q.id IS NULL THEN CASE WHEN p.id IS NOT NULL THEN n1.alias || '__' || p.name END
         ELSE n2.alias || '__' || q.name || '.' || n1.alias || '__' || p.name END AS key
  FROM features f JOIN objectclass o ON o.id = f.objectclass_id LEFT JOIN properties p ON p.feature_id = f.id AND p.datatype_id NOT IN (10, 11)
  LEFT JOIN namespace n1 ON n1.id = p.namespace_id LEFT JOIN properties q ON q.id = p.parent_id LEFT JOIN namespace n2 ON n2.id = q.namespace_id
  WHERE f.id IN (SELECT feature_id FROM geometries))"""


def _brand_sql(where, value):
    rows = ", ".join(
        f"({'NULL' if r[0] is None else repr(r[0])}, '{r[1]}', {'NULL' if r[5] is None else repr(r[5])}, '{value(r)}')" for r in RULES if where(r)
    )
    return f"(VALUES {rows}) AS v(ns, class, property_value, material_data)"


def _class_json(r):
    return DEFAULT_JSON if r[1] == "anything_else" else CLASS_JSON[r[1]]


def _any_json(r):
    # here the emissive colour is a scalar
    return PROPERTY_JSON[r[5]] if r[5] else _class_json(r).replace('["#010101"]', '"#010101"')


def _store_tiles(s, d):
    return city.class_geometries(s, d)


def _tiles(s, d, cap=400):
    return tiles.quadtree_tiles(_store_tiles(s, d), cap)


def _snapshots(s, d):
    """The derived changes with their number per feature and the other columns of the log."""
    x = (F.col("event_id") % 100).cast("double")
    return city.relation(s, d, "snapshots").withColumns({
        "seq": F.col("event_id"), "last_modification_date": F.date_trunc("hour", "ts"),
        "version": F.row_number().over(Window.partitionBy("id").orderBy("event_id")), "identifier": F.concat(F.lit("urn:"), "objectid"),
        "identifier_codespace": F.lit("urn"), "envelope": G.st_rectangle(x, F.lit(0.0), x + 1, F.lit(2.0)),
        "db_user": F.concat(F.lit("user"), (F.col("event_id") % 3).cast("string")),
    })


def _stream_log(s, d):
    """Write the derived changes as files in no order, stream them through the log a few at a time, read the result."""
    base = f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = _snapshots(s, d).drop("event_id")
    rows.repartition(6, F.xxhash64("seq")).write.parquet(f"{base}/in")
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    changelog.run_to_table(changelog.changelog_stream(source, city.dictionary(s, "objectclass")), f"{base}/out", f"{base}/state")
    log = s.read.schema(changelog.LOG_DDL).parquet(f"{base}/out").where("NOT late")
    return log.withColumns({"xmin": G.st_bbox("envelope")["xmin"], "ymax": G.st_bbox("envelope")["ymax"]}).drop("envelope", "late")


ALIVE = """steps AS (
  SELECT *, date_trunc('hour', ts) AS modified, lag(date_trunc('hour', ts)) OVER (PARTITION BY id ORDER BY event_id) AS before,
         last_value(CASE WHEN op <> 'UPDATE' THEN op END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life
  FROM snapshots WHERE objectclass_id IN (901, 801))"""


def _old_snapshot(s, d):
    """Orders as features: the state before and after a round of changes."""
    o = city.table(s, d, "orders")
    cls = F.when(F.col("o_custkey") % 3 == 0, 710).otherwise(901)
    return o.select(
        F.col("o_orderkey").alias("id"), cls.alias("objectclass_id"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("objectid"),
        F.col("o_orderdate").alias("last_modification_date"), F.lit(None).cast("timestamp").alias("termination_date"),
        F.col("o_orderpriority").alias("reason_for_update"), "o_orderstatus", "o_totalprice",
    )


def _batch_log(s, d):
    base = _old_snapshot(s, d)
    old = base.where("o_totalprice > 50000")
    new = base.where("o_totalprice < 400000").withColumns({
        "last_modification_date": F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("timestamp")).otherwise(F.col("last_modification_date")),
        "termination_date": F.when(F.col("o_totalprice") > 350000, F.lit("2024-01-01").cast("timestamp")),
    })
    named = {"identifier": F.concat(F.lit("urn:"), "objectid"), "identifier_codespace": F.lit("urn")}
    x = F.col("o_totalprice").cast("double")
    old, new = (
        df.withColumns({**named, "envelope": G.st_rectangle(x + move, F.lit(0.0), x + move + 1, F.lit(1.0))}) for df, move in ((old, 0.0), (new, 5.0))
    )
    log = changelog.changelog_from_snapshots(
        old, new, city.dictionary(s, "objectclass"), ["identifier", "identifier_codespace", "envelope"],
        F.lit("2024-02-03 04:05:06").cast("timestamp"), "clerk", 1000,
    )
    return log.withColumn("xmin", G.st_bbox("envelope")["xmin"]).drop("envelope")


CHANGELOG_SQL = (
    "SELECT 1000 + row_number() OVER (ORDER BY o_orderkey) AS id, 'urn:O' || o_orderkey AS identifier, 'urn' AS identifier_codespace, "
    "TIMESTAMP '2024-02-03 04:05:06' AS transaction_date, 'clerk' AS db_user, "
    "CAST(o_totalprice AS DOUBLE) + CASE WHEN o_totalprice < 400000 THEN 5 ELSE 0 END AS xmin, CASE WHEN o_totalprice < 400000 THEN o_orderkey END AS feature_id, 901 AS objectclass_id, 'O' || o_orderkey AS objectid, "
    "CASE WHEN o_totalprice >= 400000 THEN 'DELETE' WHEN o_totalprice > 350000 THEN 'TERMINATE' WHEN o_totalprice <= 50000 THEN 'INSERT' ELSE 'UPDATE' END AS transaction_type, "
    "CASE WHEN o_totalprice < 400000 THEN o_orderpriority END AS reason_for_update FROM orders WHERE o_custkey % 3 <> 0 AND "
    "(o_totalprice >= 400000 OR o_totalprice <= 50000 OR o_orderstatus = 'P')"
)

#: Levels the tile rule is spelled out for in SQL; the data need fewer.
SQL_LEVELS = 10


def tree_ctes(cap, name="", source="features WHERE xmin IS NOT NULL"):
    """The tile rule level by level: keep the largest per tile, hand the rest down."""
    ctes = [
        f"{name}centres AS (SELECT objectid AS id, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) * (ymax - ymin) AS area FROM {source})",
        f"{name}frame AS (SELECT min(cx) AS x0, min(cy) AS y0, greatest(max(cx) - min(cx), max(cy) - min(cy), 1e-9) AS side FROM {name}centres)",
        f"{name}rest0 AS (SELECT * FROM {name}centres, {name}frame)",
    ]
    for n in range(SQL_LEVELS + 1):
        size = float(2**n)
        ctes.append(
            f"{name}level{n} AS (SELECT *, CAST(least(floor((cx - x0) / side * {size}), {2**n - 1}) AS BIGINT) AS x, "
            f"CAST(least(floor((cy - y0) / side * {size}), {2**n - 1}) AS BIGINT) AS y FROM {name}rest{n})"
        )
        keep = f"rn <= {cap}" if n < SQL_LEVELS else "true"
        ctes.append(f"{name}ranked{n} AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY area DESC, id) AS rn FROM {name}level{n})")
        ctes.append(f"{name}tile{n} AS (SELECT id, {n} AS level, x, y FROM {name}ranked{n} WHERE {keep})")
        ctes.append(f"{name}rest{n + 1} AS (SELECT id, cx, cy, area, x0, y0, side FROM {name}ranked{n} WHERE NOT ({keep}))")
    whole = " UNION ALL ".join(f"SELECT * FROM {name}tile{n}" for n in range(SQL_LEVELS + 1))
    return [*ctes, f"{name}tiled AS ({whole})"]


def tiles_sql(cap, body):
    return oracle(f"WITH {', '.join(tree_ctes(cap))} {body}", "features")


def _content(s, d):
    """Content of two classes written, then one of them replaced under another budget."""
    path = f"{checkpoint_dir(s)}/tiles-{uuid.uuid4().hex}"
    layer = _store_tiles(s, d)
    tiles.write_tile_content(tiles.tile_content(layer, {"Building": 50, "GroundSurface": 100}), path)
    tiles.write_tile_content(tiles.tile_content(layer, {"Building": 300}), path)
    got = tiles.read_tile_content(s, path, ["Building", "GroundSurface"])
    box = G.st_bbox("geom")
    return got.select("class", "id", "level", "x", "y", box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


def content_sql(budgets):
    ctes, parts = [], []
    for i, (name, cap) in enumerate(budgets.items()):
        source = f"features f JOIN objectclass o ON o.id = f.objectclass_id AND o.classname = '{name}' WHERE f.xmin IS NOT NULL"
        ctes += [c.replace("objectid AS id", "f.objectid AS id") for c in tree_ctes(cap, f"c{i}_", source)]
        parts.append(f"SELECT '{name}' AS class, t.id, t.level, t.x, t.y, f.xmin, f.ymax FROM c{i}_tiled t JOIN features f ON f.objectid = t.id")
    return oracle(f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}", "features", "objectclass")


SUBTREE_SQL = (
    "SELECT level - level % 4 AS root_level, x >> (level % 4) AS root_x, y >> (level % 4) AS root_y, level, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS available FROM ("
    "SELECT DISTINCT level, x, y, " + " + ".join(
        f"((((x - ((x >> (level % 4)) << (level % 4))) >> {b}) & 1) << {2 * b}) + ((((y - ((y >> (level % 4)) << (level % 4))) >> {b}) & 1) << {2 * b + 1})" for b in range(4)
    ) + " AS m FROM tiled) GROUP BY 1, 2, 3, 4"
)

ENTRIES = {
    "material_by_class": (
        lambda s, d: materials.material_by_class(rules_per_brand(s, d)),
        "SELECT concat_ws('/', p_brand, ns) AS ns, class, material_data FROM (SELECT DISTINCT p_brand FROM part), "
        + _brand_sql(lambda r: r[5] is None, _class_json),
    ),
    "material_by_property": (
        lambda s, d: materials.material_by_property(rules_per_brand(s, d)).select("namespace_of_classname", "classname", "property_value", "material_data"),
        "SELECT concat_ws('/', p_brand, ns) AS namespace_of_classname, class AS classname, property_value, material_data FROM (SELECT DISTINCT p_brand FROM part), "
        + _brand_sql(lambda r: True, _any_json),
    ),
    "material_property_match": (
        matches,
        oracle(f"WITH {MATCH_CTE} SELECT objectid, alias, name, val_string, val_int, val_double, material_data FROM property_materials", "features", "properties", "namespace"),
    ),
    "material_from_appearance": (
        appearance_materials,
        oracle(f"WITH {APPEARANCE_CTE} SELECT objectid, material_data FROM appearance_materials", "geometries", "features", "surface_mappings", "surface_datas"),
    ),
    "styled_geometries": (styled(materials.EXISTING, materials.FALL_DOWN), styled_sql(("appearance", "property", "class"))),
    "styled_no_style": (styled(materials.NO_STYLE, materials.FALL_DOWN), styled_sql(("default",))),
    "styled_by_class": (
        styled(materials.BY_CLASS, materials.FALL_DOWN, exclude=["GroundSurface", "RoofSurface"]),
        styled_sql(("class", "default"), "AND o.classname NOT IN ('GroundSurface', 'RoofSurface')"),
    ),
    "styled_by_property": (styled(materials.BY_PROPERTY, materials.FALL_DOWN), styled_sql(("property", "class"))),
    "styled_class_rise_up": (styled(materials.BY_CLASS, materials.RISE_UP), styled_sql(("class", "property", "appearance"))),
    "styled_property_rise_up": (styled(materials.BY_PROPERTY, materials.RISE_UP), styled_sql(("property", "appearance"))),
    "advise": (
        lambda s, d: advice.advise(city.store(s, d), {"command": "advise"}, by_class=True).select(F.explode("objectclasses").alias("c")).select(
            "c.name", F.col("c.objectclass_recommendations").alias("recommended"), F.to_json("c.properties").alias("properties")
        ),
        oracle(
            f"WITH {CLASS_KEYS} SELECT classname AS name, CAST(round(10000 / 5.0) AS INTEGER) AS recommended, "
            "'[' || string_agg(coalesce('\"' || key || '\"', 'null'), ',' ORDER BY key NULLS LAST) || ']' AS properties FROM class_keys GROUP BY classname",
            "features", "properties", "geometries", "objectclass", "namespace",
        ),
    ),
    "tile_budget": (
        lambda s, d: advice.max_features_per_tile(advice.vertex_stats(city.geometry_data(s, d), city.feature(s, d), city.dictionary(s, "objectclass"))).select(
            advice.tile_budget(F.col("max_features_per_tile")).alias("effective_cap"), "geometries_total"
        ),
        oracle("SELECT 10000 AS effective_cap, count(*) AS geometries_total FROM geometries", "geometries"),
    ),
    "quadtree_tiles": (lambda s, d: _tiles(s, d), tiles_sql(400, "SELECT id, level, x, y FROM tiled")),
    "tileset_manifest": (lambda s, d: tiles.tileset_manifest(_store_tiles(s, d), _tiles(s, d)), None),
    "subtree_availability": (
        lambda s, d: tiles.subtree_availability(_tiles(s, d, 50)).withColumn("available", F.array_join(F.transform("available", lambda v: v.cast("string")), ",")),
        tiles_sql(50, SUBTREE_SQL),
    ),
    "separate_tilesets": (
        lambda s, d: tiles.separate_tilesets(_store_tiles(s, d), {"Building": 300, "GroundSurface": 100}).groupBy("class").agg(F.count(F.lit(1)).alias("features")),
        oracle(
            "SELECT o.classname AS class, count(*) AS features FROM features f JOIN objectclass o ON o.id = f.objectclass_id WHERE f.xmin IS NOT NULL GROUP BY o.classname",
            "features", "objectclass",
        ),
    ),
    "tile_content": (_content, content_sql({"Building": 300, "GroundSurface": 100})),
    "feature_changelog": (
        _stream_log,
        oracle(
            f"WITH {ALIVE} SELECT event_id AS id, 'urn:' || objectid AS identifier, 'urn' AS identifier_codespace, 'user' || (event_id % 3) AS db_user, "
            "CAST(CASE WHEN op = 'DELETE' THEN place ELSE event_id % 100 END AS DOUBLE) AS xmin, CAST(2 AS DOUBLE) AS ymax, "
            "CASE WHEN op <> 'DELETE' THEN id END AS feature_id, CAST(objectclass_id AS INTEGER) AS objectclass_id, objectid, "
            "CASE WHEN op = 'DELETE' THEN op WHEN termination_date IS NOT NULL THEN 'TERMINATE' ELSE op END AS transaction_type, ts AS transaction_date, "
            "CASE WHEN op <> 'DELETE' THEN reason_for_update END AS reason_for_update FROM (SELECT *, last_value(CASE WHEN op = 'INSERT' OR (op = 'UPDATE' AND life = 'INSERT') "
            "THEN event_id % 100 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM steps) "
            "WHERE op = 'INSERT' OR (life = 'INSERT' AND (op = 'DELETE' OR modified <> before))", "snapshots",
        ),
    ),
    "feature_changelog_batch": (_batch_log, CHANGELOG_SQL),
}
