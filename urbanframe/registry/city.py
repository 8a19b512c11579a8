"""A city model derived from the given tables.

Each relation is one SQL text over the given tables, used for Spark and, with
``DIV`` spelled ``//``, as a CTE of the oracle SQL. All coordinates are whole
metres, so areas and squared distances are exact. Spark then adds geometry
structs and the remaining store columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.schema import table_schema
from urbanframe.session import cut_lineage, spread

SURFACE, ARM, INSTALL, NESTED, TEMPLATE = 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9, 5 * 10**9

# ---- input relations -------------------------------------------------------
BUILDINGS = """
SELECT p_partkey AS k, x0, y0, x0 + 4 + p_size % 12 AS x1, y0 + 4 + (p_partkey * 7) % 10 AS y1,
       CAST(10 + (p_partkey * 17) % 600 AS DOUBLE) / CAST(10 AS DOUBLE) AS height_m,
       p_partkey % 7 AS z, p_type, p_size
FROM (SELECT p_partkey, p_type, p_size,
             (p_partkey % 50) * 20 + (p_partkey * 13) % 9 AS x0,
             (p_partkey DIV 50) * 20 + (p_partkey * 29) % 9 AS y0
      FROM {part}) base
"""

PARCELS = """
SELECT c_custkey AS id, (c_custkey % 50) * 30 AS x0, (c_custkey DIV 50) * 30 AS y0,
       (c_custkey % 50) * 30 + 10 + (c_custkey % 3) * 8 AS x1,
       (c_custkey DIV 50) * 30 + 10 + (c_custkey % 3) * 8 AS y1
FROM {customer}
"""

GREENS = """
SELECT s_suppkey AS id, (s_suppkey * 197) % 1100 AS x0, s_suppkey * 9 AS y0,
       (s_suppkey * 197) % 1100 + 20 + (s_suppkey % 5) * 10 AS x1,
       s_suppkey * 9 + 15 + (s_suppkey % 7) * 5 AS y1
FROM {supplier} WHERE s_suppkey % 4 = 0
"""

# Ground surfaces: the main rectangle of every building and an arm on every fourth.
SURFACES = f"""
SELECT k + {SURFACE} AS sid, k, x0, y0, x1, y1, z, height_m FROM {{buildings}}
UNION ALL
SELECT k + {ARM} AS sid, k, x0, y1 AS y0, x0 + (x1 - x0) DIV 4 AS x1, y1 + 12 AS y1, z, height_m
FROM {{buildings}} WHERE k % 4 = 0
"""

_BOX = """CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(z AS DOUBLE) AS zmin,
       CAST(x1 AS DOUBLE) AS xmax, CAST({ytop} AS DOUBLE) AS ymax, z + height_m AS zmax"""
_NOBOX = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))
_ENDED = "CASE WHEN k % 11 = 5 THEN TIMESTAMP '2024-01-01 00:00:00' END AS termination_date"
_OPEN = "CAST(NULL AS TIMESTAMP) AS termination_date"

FEATURES = f"""
SELECT k AS id, 901 AS objectclass_id, CONCAT('B', CAST(k AS VARCHAR(20))) AS objectid,
       {_BOX.format(ytop='CASE WHEN k % 4 = 0 THEN y1 + 12 ELSE y1 END')}, {_ENDED}
FROM {{buildings}}
UNION ALL
SELECT sid AS id, 710 AS objectclass_id,
       CONCAT(CASE WHEN sid < {ARM} THEN 'G' ELSE 'A' END, CAST(k AS VARCHAR(20))) AS objectid,
       {_BOX.format(ytop='y1')}, {_OPEN}
FROM {{surfaces}}
UNION ALL
SELECT k + {INSTALL} AS id, 905 AS objectclass_id, CONCAT('I', CAST(k AS VARCHAR(20))) AS objectid, {_NOBOX}, {_OPEN}
FROM {{buildings}} WHERE k % 10 = 3
UNION ALL
SELECT k + {NESTED} AS id, 905 AS objectclass_id, CONCAT('N', CAST(k AS VARCHAR(20))) AS objectid, {_NOBOX}, {_OPEN}
FROM {{buildings}} WHERE k % 10 = 3
"""

_PROPERTY_COLUMNS = {
    "parent_id": "BIGINT", "datatype_id": "INT", "namespace_id": "INT", "name": "VARCHAR(40)",
    "val_int": "BIGINT", "val_double": "DOUBLE", "val_string": "VARCHAR(80)", "val_lod": "VARCHAR(8)",
    "val_array": "VARCHAR(200)", "val_geometry_id": "BIGINT", "val_implicitgeom_id": "BIGINT",
    "refx": "DOUBLE", "refy": "DOUBLE", "refz": "DOUBLE", "val_appearance_id": "BIGINT",
    "val_address_id": "BIGINT", "val_feature_id": "BIGINT", "val_relation_type": "INT",
}


def _prop(pid: str, owner: str, source: str, **cols: str) -> str:
    body = ", ".join(f"CAST({cols.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _PROPERTY_COLUMNS.items())
    return f"SELECT CAST({pid} AS BIGINT) AS id, CAST({owner} AS BIGINT) AS feature_id, {body} FROM {source}"


_B, _S = "{buildings}", "{surfaces}"
_REL = {"datatype_id": "10", "namespace_id": "10", "val_relation_type": "1"}
_SHIFT_MATRIX = "'[2,0,0,1,0,1,0,2,0,0,1,3,0,0,0,1]'"
PROPERTIES = "\nUNION ALL\n".join([
    _prop("k * 100 + CASE WHEN sid < %d THEN 1 ELSE 2 END" % ARM, "k", _S, name="'boundary'", datatype_id="10",
          namespace_id="1", val_feature_id="sid", val_relation_type="1"),
    _prop("k * 100 + 3", "k", _B, name="'roofType'", datatype_id="14", namespace_id="10", val_string="p_type"),
    _prop("k * 100 + 4", "k", _B, name="'storeys'", datatype_id="3", namespace_id="10", val_int="p_size"),
    _prop("k * 100 + 5", "k", _B, name="'height'", datatype_id="17", namespace_id="8", val_double="height_m"),
    _prop("k * 100 + 6", "k", _B, name="'status'", datatype_id="5", namespace_id="8", parent_id="k * 100 + 5",
          val_string="'measured'"),
    _prop("k * 100 + 7", "k", _B + " WHERE k % 10 = 3", name="'buildingInstallation'",
          val_feature_id=f"k + {INSTALL}", **_REL),
    # the next building shares or only mentions the installation
    _prop("k * 100 + 8", "k", _B + " WHERE k % 20 = 14", name="'buildingInstallation'",
          val_feature_id=f"k - 1 + {INSTALL}", **_REL),
    _prop("k * 100 + 9", "k", _B + " WHERE k % 20 = 4", name="'relatedTo'", datatype_id="10", namespace_id="1",
          val_feature_id=f"k - 1 + {INSTALL}", val_relation_type="0"),
    _prop("k * 100 + 10", "k", _B + " WHERE k % 5 = 0", name="'address'", datatype_id="8", namespace_id="10",
          val_address_id="k"),
    _prop("k * 100 + 11", "k", _B + " WHERE k % 3 = 0", name="'appearance'", datatype_id="9", namespace_id="1",
          val_appearance_id="k"),
    # a generic attribute with a nested value of the same name
    _prop("k * 100 + 12", "k", _B + " WHERE k % 2 = 0", name="'energyClass'", datatype_id="5", namespace_id="3",
          val_string="'A'"),
    _prop("k * 100 + 13", "k", _B + " WHERE k % 2 = 0", name="'energyClass'", datatype_id="5", namespace_id="3",
          parent_id="k * 100 + 12", val_string="'A+'"),
    _prop("sid * 100 + 1", "sid", _S, name="'lod2MultiSurface'", datatype_id="11", namespace_id="1",
          val_geometry_id="sid", val_lod="'2'"),
    _prop("sid * 100 + 2", "sid", _S + " WHERE k % 3 = 1", name="'condition'", datatype_id="5", namespace_id="3",
          val_string="'good'"),
    _prop("sid * 100 + 3", "sid", _S + " WHERE k % 3 = 1", name="'inspector'", datatype_id="5", namespace_id="8",
          parent_id="sid * 100 + 2", val_string="'team'"),
    _prop(f"(k + {INSTALL}) * 100 + 1", f"k + {INSTALL}", _B + " WHERE k % 10 = 3", name="'buildingInstallation'",
          val_feature_id=f"k + {NESTED}", **_REL),
    _prop(f"(k + {INSTALL}) * 100 + 2", f"k + {INSTALL}", _B + " WHERE k % 10 = 3", name="'lod3MultiSurface'",
          datatype_id="11", namespace_id="1", val_geometry_id=f"k + {INSTALL}", val_lod="'3'"),
    _prop(f"(k + {NESTED}) * 100 + 1", f"k + {NESTED}", _B + " WHERE k % 10 = 3", name="'lod2ImplicitRepresentation'",
          datatype_id="16", namespace_id="1", val_lod="'2'", val_implicitgeom_id="(k DIV 10) % 10",
          refx="x0 + 2", refy="y0 + 2", refz="z", val_array=f"CASE WHEN k % 20 = 3 THEN {_SHIFT_MATRIX} END"),
])

# Geometry rows as rectangles; t* are the bounds of a template geometry.
_TNULL = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("tx1", "ty1"))
GEOMETRIES = f"""
SELECT sid AS id, sid AS feature_id, CAST(x0 AS DOUBLE) AS gx0, CAST(y0 AS DOUBLE) AS gy0, CAST(x1 AS DOUBLE) AS gx1,
       CAST(y1 AS DOUBLE) AS gy1, CAST(z AS DOUBLE) AS gz, {_TNULL},
       CONCAT(CASE WHEN sid < {ARM} THEN 'S' ELSE 'T' END, CAST(k AS VARCHAR(20))) AS surface
FROM {{surfaces}}
UNION ALL
SELECT k + {INSTALL} AS id, k + {INSTALL} AS feature_id, CAST(x0 AS DOUBLE) AS gx0, CAST(y0 AS DOUBLE) AS gy0,
       CAST(x0 + 1 AS DOUBLE) AS gx1, CAST(y0 + 1 AS DOUBLE) AS gy1, z + height_m + 2 AS gz, {_TNULL},
       CONCAT('U', CAST(k AS VARCHAR(20))) AS surface
FROM {{buildings}} WHERE k % 10 = 3
UNION ALL
SELECT s_suppkey + {TEMPLATE} AS id, CAST(NULL AS BIGINT) AS feature_id, CAST(NULL AS DOUBLE) AS gx0,
       CAST(NULL AS DOUBLE) AS gy0, CAST(NULL AS DOUBLE) AS gx1, CAST(NULL AS DOUBLE) AS gy1, CAST(NULL AS DOUBLE) AS gz,
       CAST(1 + s_suppkey % 3 AS DOUBLE) AS tx1, CAST(1 + s_suppkey % 2 AS DOUBLE) AS ty1,
       CAST(NULL AS VARCHAR(20)) AS surface
FROM {{supplier}}
"""

TEMPLATES = f"""
SELECT s_suppkey AS id, CONCAT('tmpl', CAST(s_suppkey AS VARCHAR(20))) AS objectid,
       CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey + {TEMPLATE} END AS relative_geometry_id
FROM {{supplier}}
"""

APPEARANCES = """
SELECT k AS id, CONCAT('theme', CAST(k % 2 AS VARCHAR(2))) AS theme, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS is_global,
       k AS feature_id
FROM {buildings} WHERE k % 3 = 0
"""

# Two appearances share one surface data row, three rows share one texture.
APPEARANCE_LINKS = """
SELECT k AS id, k AS appearance_id, k DIV 6 AS surface_data_id FROM {buildings} WHERE k % 3 = 0
"""

SURFACE_DATA = """
SELECT k DIV 6 AS id, CASE WHEN (k DIV 6) % 5 = 4 THEN 1104 ELSE 1102 END AS objectclass_id,
       CASE WHEN (k DIV 6) % 2 = 0 THEN CAST((k DIV 6) % 5 AS DOUBLE) / CAST(4 AS DOUBLE) END AS x3d_shininess,
       CASE WHEN (k DIV 6) % 3 = 0 THEN CAST((k DIV 6) % 9 AS DOUBLE) / CAST(8 AS DOUBLE) END AS x3d_ambient_intensity,
       CASE WHEN (k DIV 6) % 4 <> 1 THEN CONCAT('#0000', CAST(10 + (k DIV 6) % 90 AS VARCHAR(2))) END AS x3d_diffuse_color,
       CASE WHEN (k DIV 6) % 6 = 0 THEN '#111111' END AS x3d_emissive_color,
       CASE WHEN (k DIV 6) % 7 = 0 THEN '#222222' END AS x3d_specular_color,
       CASE WHEN (k DIV 6) % 2 = 1 THEN k DIV 36 END AS tex_image_id
FROM {buildings} WHERE k % 6 = 0
"""

SURFACE_MAPPINGS = f"""
SELECT k DIV 6 AS surface_data_id, k + {SURFACE} AS geometry_data_id,
       CONCAT('{{{{"S', CAST(k AS VARCHAR(20)), '":true,"S', CAST(k + 1 AS VARCHAR(20)), '":false}}}}') AS material_mapping,
       CASE WHEN (k DIV 6) % 5 = 4 THEN '{{{{"R1":[[0,0]]}}}}' END AS texture_mapping
FROM {{buildings}} WHERE k % 6 = 0
"""

TEXTURES = """
SELECT k DIV 36 AS id, CONCAT('tex', CAST(k DIV 36 AS VARCHAR(20)), '.png') AS image_uri FROM {buildings} WHERE k % 36 = 0
"""

ADDRESSES = """
SELECT k AS id, CONCAT('Street ', CAST(k % 100 AS VARCHAR(4))) AS street, CAST(k AS VARCHAR(20)) AS house_number
FROM {buildings} WHERE k % 5 = 0
"""

# Change stream: one row per event of a feature (the user), in time order.
SNAPSHOTS = """
SELECT event_id, user_id AS id, ts,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
       CASE WHEN event_type = 'purchase' THEN ts END AS termination_date,
       CASE user_id % 3 WHEN 0 THEN 710 WHEN 1 THEN 901 ELSE 801 END AS objectclass_id,
       CONCAT('F', CAST(user_id AS VARCHAR(20))) AS objectid, event_type AS reason_for_update
FROM {events}
"""

RELATIONS = {
    "buildings": BUILDINGS, "parcels": PARCELS, "greens": GREENS, "surfaces": SURFACES,
    "features": FEATURES, "properties": PROPERTIES, "geometries": GEOMETRIES, "templates": TEMPLATES,
    "appearances": APPEARANCES, "appearance_links": APPEARANCE_LINKS, "surface_datas": SURFACE_DATA,
    "surface_mappings": SURFACE_MAPPINGS, "textures": TEXTURES, "addresses": ADDRESSES, "snapshots": SNAPSHOTS,
}
_NEEDS = {
    "surfaces": ["buildings"], "features": ["buildings", "surfaces"], "properties": ["buildings", "surfaces"],
    "geometries": ["buildings", "surfaces"],
}
for _n in ("appearances", "appearance_links", "surface_datas", "surface_mappings", "textures", "addresses"):
    _NEEDS[_n] = ["buildings"]
GIVEN = ("part", "customer", "supplier", "orders", "events", "nation", "region", "lineitem")

# ---- dictionaries (fixed values: id, parent id, class, abstract, top level, namespace id) ----
CLASSES = [
    (1, None, "Undefined", 1, 0, 1), (2, None, "AbstractObject", 1, 0, 1), (3, 2, "AbstractFeature", 1, 0, 1),
    (6, 3, "AbstractFeatureWithLifespan", 1, 0, 1), (7, 6, "AbstractCityObject", 1, 0, 1),
    (8, 7, "AbstractSpace", 1, 0, 1), (10, 8, "AbstractPhysicalSpace", 1, 0, 1),
    (12, 10, "AbstractOccupiedSpace", 1, 0, 1), (13, 7, "AbstractSpaceBoundary", 1, 0, 1),
    (14, 13, "AbstractThematicSurface", 1, 0, 1), (15, 14, "ClosureSurface", 0, 0, 1),
    (700, 12, "AbstractConstruction", 1, 0, 8), (701, 700, "OtherConstruction", 0, 1, 8),
    (707, 12, "AbstractInstallation", 1, 0, 8), (708, 14, "AbstractConstructionSurface", 1, 0, 8),
    (709, 708, "WallSurface", 0, 0, 8), (710, 708, "GroundSurface", 0, 0, 8), (712, 708, "RoofSurface", 0, 0, 8),
    (800, 700, "AbstractTunnel", 1, 0, 9), (801, 800, "Tunnel", 0, 1, 9),
    (900, 700, "AbstractBuilding", 1, 0, 10), (901, 900, "Building", 0, 1, 10), (902, 900, "BuildingPart", 0, 0, 10),
    (905, 707, "BuildingInstallation", 0, 0, 10),
    (1101, None, "AbstractSurfaceData", 1, 0, 12), (1102, 1101, "X3DMaterial", 0, 0, 12),
    (1103, 1101, "AbstractTexture", 1, 0, 12), (1104, 1103, "ParameterizedTexture", 0, 0, 12),
]
NAMESPACES = [
    (1, "core"), (2, "dyn"), (3, "gen"), (4, "luse"), (5, "pcl"), (6, "dem"), (7, "tran"), (8, "con"), (9, "tun"),
    (10, "bldg"), (11, "brid"), (12, "app"), (13, "grp"), (14, "veg"), (15, "vers"), (16, "wtr"), (17, "frn"), (18, "depr"),
]
# Data type ids and names used by the derived properties.
DATATYPES = [
    (1, "Undefined"), (2, "Boolean"), (3, "Integer"), (4, "Double"), (5, "String"), (8, "AddressProperty"),
    (9, "AppearanceProperty"), (10, "FeatureProperty"), (11, "GeometryProperty"), (14, "Code"),
    (16, "ImplicitGeometryProperty"), (17, "Measure"),
]


def _values(rows, cols) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


CLASS_COLUMNS = ("id", "superclass_id", "classname", "is_abstract", "is_toplevel", "namespace_id")
DICTIONARIES = {
    "objectclass": _values(CLASSES, CLASS_COLUMNS),
    "namespace": _values(NAMESPACES, ("id", "alias")),
    "datatype": _values(DATATYPES, ("id", "typename")),
}


# ---- oracle side -----------------------------------------------------------
def oracle(body: str, *names: str) -> str:
    """Oracle SQL: the named derived relations as CTEs, then the body."""
    ordered: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        need(n)
    ctes = []
    for n in ordered:
        if n in DICTIONARIES:
            ctes.append(f"{n} AS ({DICTIONARIES[n]})")
            continue
        text = RELATIONS[n].replace(" DIV ", " // ")
        text = text.format(**{g: g for g in GIVEN}, **{r: r for r in RELATIONS})
        ctes.append(f"{n} AS ({text})")
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:].lstrip()
        recursive = rest.upper().startswith("RECURSIVE ")
        if recursive:
            rest = rest[10:]
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- Spark side ------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Given tables whose rows become features and shapes, with the columns these take: dealt to all cores before that.
_READ = {"part": ["p_partkey", "p_type", "p_size"], "customer": ["c_custkey"], "supplier": ["s_suppkey"]}


_DEALT: dict[tuple, DataFrame] = {}


def _dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table dealt to all cores. Parts are written so once per session: many parts of a relation read their buildings."""
    df = table(spark, sf, name).select(_READ[name])
    if name != "part":
        return spread(df)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DEALT:
        dealt = spread(df)
        _DEALT[key] = df if dealt is df else cut_lineage(dealt)
    return _DEALT[key]


def relation(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = RELATIONS[name]
    frames = {}
    for n in _NEEDS.get(name, []):
        if "{" + n + "}" in text:
            frames[n] = relation(spark, sf, n)
    for g in GIVEN:
        if "{" + g + "}" in text:
            frames[g] = _dealt(spark, sf, g) if g in _READ else table(spark, sf, g)
    return spark.sql(text, **frames)


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Store layout: fixed columns and types, missing ones null."""
    have = set(df.columns)
    return df.select(
        [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name)]
    )


def dictionary(spark: SparkSession, name: str) -> DataFrame:
    """A literal table: Spark knows its size and broadcasts it by its own threshold."""
    return _conform(spark.sql(DICTIONARIES[name]), name)


def _feature(spark, sf) -> DataFrame:
    df = relation(spark, sf, "features")
    box = F.when(
        F.col("xmin").isNotNull(),
        G.bbox_struct(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("zmin"), F.col("zmax")),
    )
    df = df.withColumns({
        "envelope": G.slanted_envelope(box),
        "creation_date": F.lit("2020-01-01").cast("timestamp"),
        "last_modification_date": F.lit("2023-01-01").cast("timestamp"),
        "updating_person": F.lit("import"),
    })
    return _conform(df, "feature")


def _property(spark, sf) -> DataFrame:
    df = relation(spark, sf, "properties")
    ref = F.when(F.col("refx").isNotNull(), G.st_point(F.col("refx"), F.col("refy"), F.col("refz")))
    return _conform(df.withColumn("val_implicitgeom_refpoint", ref), "property")


def _geometry_data(spark, sf) -> DataFrame:
    df = relation(spark, sf, "geometries")
    geom = F.when(
        F.col("gx0").isNotNull(),
        G.st_rectangle(F.col("gx0"), F.col("gy0"), F.col("gx1"), F.col("gy1"), F.col("gz")),
    )
    template = F.when(F.col("tx1").isNotNull(), G.st_rectangle(F.lit(0.0), F.lit(0.0), F.col("tx1"), F.col("ty1"), srid=0))
    props = F.when(
        F.col("surface").isNotNull(),
        F.concat(F.lit('{"type":9,"children":[{"type":5,"objectId":"'), F.col("surface"), F.lit('"}]}')),
    )
    df = df.withColumns({"geometry": geom, "implicit_geometry": template, "geometry_properties": props})
    return _conform(df, "geometry_data")


_STORE = {
    "implicit_geometry": "templates", "appearance": "appearances", "appear_to_surface_data": "appearance_links",
    "surface_data": "surface_datas", "surface_data_mapping": "surface_mappings", "tex_image": "textures",
    "address": "addresses",
}


_TABLES: dict[tuple, DataFrame] = {}


def store_table(spark, sf, name: str) -> DataFrame:
    """A table of the derived store, written once per session as input data."""
    if name in DICTIONARIES:
        return dictionary(spark, name)
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        build = _BUILDERS.get(name)
        df = build(spark, sf) if build else _conform(relation(spark, sf, _STORE[name]), name)
        _TABLES[key] = cut_lineage(df)
    return _TABLES[key]


STORE_TABLES = ("feature", "property", "geometry_data", *_STORE, *DICTIONARIES)


def store(spark, sf) -> dict[str, DataFrame]:
    return {n: store_table(spark, sf, n) for n in STORE_TABLES}


def _layer(df: DataFrame, key: str) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return df.select(
        F.col("id").alias(key), G.st_rectangle(x0, y0, x1, y1).alias("geom"), G.bbox_struct(x0, y0, x1, y1).alias("bbox")
    )


def _greens(spark, sf) -> DataFrame:
    return _layer(relation(spark, sf, "greens"), "id")


def _parcels(spark, sf) -> DataFrame:
    return _layer(relation(spark, sf, "parcels"), "id")


def _class_geometries(spark, sf) -> DataFrame:
    """Prepared geometry layer: one 3D geometry per feature with its class and material column."""
    f = relation(spark, sf, "features").where("xmin is not null")
    box = G.bbox_struct(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("zmin"), F.col("zmax"))
    oc = dictionary(spark, "objectclass").select(F.col("id").alias("objectclass_id"), "classname")
    return f.join(oc, "objectclass_id").select(
        F.col("objectid").alias("id"), F.col("classname").alias("class"), G.slanted_envelope(box).alias("geom")
    )


_BUILDERS = {
    "feature": _feature, "property": _property, "geometry_data": _geometry_data, "greens": _greens,
    "parcels": _parcels, "class_geometries": _class_geometries,
}


def feature(spark, sf) -> DataFrame:
    return store_table(spark, sf, "feature")


def property_rows(spark, sf) -> DataFrame:
    return store_table(spark, sf, "property")


def geometry_data(spark, sf) -> DataFrame:
    return store_table(spark, sf, "geometry_data")


def greens(spark, sf) -> DataFrame:
    return store_table(spark, sf, "greens")


def parcels(spark, sf) -> DataFrame:
    return store_table(spark, sf, "parcels")


def class_geometries(spark, sf) -> DataFrame:
    return store_table(spark, sf, "class_geometries")
