"""Sources, sinks and layer management."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.projection import st_transform
from urbanframe.functions.scalars import round_numeric
from urbanframe.operators import advice
from urbanframe.operators.filters import duplicate_keys
from urbanframe.operators.ids import assign_ids
from urbanframe.registry import city, layers
from urbanframe.registry.city import oracle, table
from urbanframe.session import checkpoint_dir
from urbanframe.sources import tables, vector
from urbanframe.sources.catalogue import Catalogue


def _folder(s):
    return f"{checkpoint_dir(s)}/io-{uuid.uuid4().hex}"


def _city_tables(s, d):
    path = _folder(s)
    tables.write_city_tables(city.store(s, d), path)
    got = tables.read_city_tables(s, path, list(city.STORE_TABLES))
    return tables.layer_row_counts({n: got[n] for n in ("feature", "property", "geometry_data", "appearance", "tex_image", "objectclass")})


def _all_tables(s, d):
    """The derived store with the remaining tables: extensions by region, code lists and systems by nation, codes by part."""
    n, p, r = table(s, d, "nation"), table(s, d, "part"), table(s, d, "region")
    more = {
        "ade": r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("1.0").alias("version")),
        "codelist": n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("type"), F.col("n_regionkey").cast("string")).alias("codelist_type"), F.col("n_name").alias("url")),
        "codelist_entry": p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("codelist_id"), F.col("p_type").alias("code"), F.col("p_name").alias("definition")),
        "database_srs": n.select((F.col("n_nationkey") + 3000).alias("srid"), F.col("n_name").alias("srs_name")),
    }
    return {**city.store(s, d), **{name: city._conform(df, name) for name, df in more.items()}}


# Key and one value of every table of the store.
_VALUES = {
    "address": ("id", "street"), "ade": ("id", "name"), "appear_to_surface_data": ("appearance_id", "surface_data_id"), "appearance": ("id", "theme"),
    "codelist": ("id", "url"), "codelist_entry": ("id", "code"), "database_srs": ("srid", "srs_name"), "datatype": ("id", "typename"),
    "feature": ("id", "objectid"), "geometry_data": ("id", "feature_id"), "implicit_geometry": ("id", "relative_geometry_id"), "namespace": ("id", "alias"),
    "objectclass": ("id", "classname"), "property": ("id", "name"), "surface_data": ("id", "x3d_diffuse_color"),
    "surface_data_mapping": ("surface_data_id", "geometry_data_id"), "tex_image": ("id", "image_uri"),
}
_VALUE_SOURCES = {
    "address": "addresses", "ade": "(SELECT r_regionkey AS id, r_name AS name FROM region)", "appear_to_surface_data": "appearance_links", "appearance": "appearances",
    "codelist": "(SELECT n_nationkey AS id, n_name AS url FROM nation)", "codelist_entry": "(SELECT p_partkey AS id, p_type AS code FROM part)",
    "database_srs": "(SELECT n_nationkey + 3000 AS srid, n_name AS srs_name FROM nation)", "datatype": "datatype", "feature": "features", "geometry_data": "geometries",
    "implicit_geometry": "templates", "namespace": "namespace", "objectclass": "objectclass", "property": "properties", "surface_data": "surface_datas",
    "surface_data_mapping": "surface_mappings", "tex_image": "textures",
}


def _table_values(s, d):
    """All seventeen tables written and read back, with a value of every row."""
    path = _folder(s)
    tables.write_city_tables(_all_tables(s, d), path)
    got, out = tables.read_city_tables(s, path), None
    for name, (key, value) in _VALUES.items():
        part = got[name].select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("k"), F.col(value).cast("string").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def _placed_parcels(s, d):
    """Parcels moved to the projection's valid area."""
    return city.parcels(s, d).select("id", G.st_translate("geom", 25490000.0, 6670000.0).alias("geom"))


def _published(s, d):
    """Write a layer as GeoJSON, read it back as a metric layer."""
    path = _folder(s)
    vector.write_geojson_layer(_placed_parcels(s, d), path)
    return vector.read_feature_collection(s, path, "id bigint", srid=4326, target=3879, by_line=True)


def _feature_collection(s, d):
    """GeoJSON with upper-case property names in metres, read into degrees and measured back."""
    path = _folder(s)
    p = _placed_parcels(s, d).select(F.col("id").alias("ID"), "geom")
    text = F.concat(
        F.when(F.col("_m").bitwiseAND((1 << 33) - 1) == 0, "").otherwise(","), F.lit('{"type":"Feature","geometry":'), vector.to_geojson("geom"),
        F.lit(',"properties":{"ID":'), F.col("ID").cast("string"), F.lit(',"NAME":"p'), F.col("ID").cast("string"), F.lit('"}}'),
    )
    lines = p.withColumn("_m", F.monotonically_increasing_id()).select(text.alias("value"))
    vector.write_framed(lines, path, '{"type":"FeatureCollection","features":[', "]}")
    got = vector.read_feature_collection(s, path, "ID bigint, NAME string")
    return got.select("id", "name", G.srid_of("geom").alias("srid"), round_numeric(G.st_area(st_transform("geom", 3879)), 2).alias("area"))


def _gml(s, d):
    """Buildings as XML members: two ground surfaces where there is an arm."""
    b = city.relation(s, d, "buildings")

    def surface(tag, name, x0, y0, x1, y1):
        def n(v):
            return v.cast("double").cast("string")

        def pt(x, y):
            return F.concat_ws(" ", n(x), n(y), n(F.col("z")))

        ring = F.concat_ws(" ", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
        return F.concat(
            F.lit(f'<bldg:boundedBy><bldg:{tag} gml:id="'), name, F.lit('"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id="p'), name,
            F.lit('"><gml:exterior><gml:LinearRing><gml:posList>'), ring,
            F.lit(f"</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:{tag}></bldg:boundedBy>"),
        )

    k = F.col("k").cast("string")
    c = {v: F.col(v) for v in ("x0", "y0", "x1", "y1")}
    arm = F.when(F.col("k") % 4 == 0, surface("GroundSurface", F.concat(F.lit("A"), k), c["x0"], c["y1"], c["x0"] + F.expr("(x1 - x0) div 4"), c["y1"] + 12)).otherwise("")
    xml = F.concat(
        F.lit('<bldg:Building gml:id="B'), k, F.lit('"><bldg:measuredHeight>'), F.col("height_m").cast("string"), F.lit("</bldg:measuredHeight>"),
        surface("GroundSurface", F.concat(F.lit("G"), k), c["x0"], c["y0"], c["x1"], c["y1"]), arm, F.lit("</bldg:Building>"),
    )
    path = _folder(s)
    head = '<core:CityModel xmlns:core="urn:core" xmlns:bldg="urn:bldg" xmlns:gml="urn:gml">'
    vector.write_framed(b.select(F.concat(F.lit("<core:cityObjectMember>"), xml, F.lit("</core:cityObjectMember>")).alias("value")), path, head, "</core:CityModel>")
    got = vector.read_citygml(s, path)
    f, p, g = got["feature"], got["property"], got["geometry_data"]
    area = g.select(F.col("id").alias("gid"), G.st_area("geometry").alias("area"))
    owner = p.where("name = 'boundary'").select(F.col("feature_id").alias("id"), F.col("val_feature_id").alias("gid"))
    height = p.where("name = 'height'").select(F.col("feature_id").alias("id"), "val_double")
    return (
        f.where("classname = 'Building'").join(owner, "id").join(area, "gid").join(height, "id").groupBy("objectid", "val_double")
        .agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("surfaces")).withColumnRenamed("val_double", "height")
    )


def _rules_csv(s, d):
    """Part brands and types as a rule file, read back with empty text as null."""
    path = _folder(s)
    p = table(s, d, "part").select("p_brand", "p_type").distinct()
    cols = [F.lit(None).cast("string").alias(c) for c in vector.RULE_COLUMNS]
    named = {"namespace_of_classname": F.lit("bldg"), "classname": F.col("p_brand"), "property_value": F.col("p_type")}
    cols = [named[c].alias(c) if c in named else col for c, col in zip(vector.RULE_COLUMNS, cols)]
    p.select(cols).write.option("header", True).csv(path)
    return vector.read_material_rules(s, path).select("id", "classname", "property_value", F.col("emmisive_color").isNull().alias("no_colour"))


def _saved(s, d):
    """A layer written twice: the second version takes the place of the first."""
    name = f"layer_{uuid.uuid4().hex[:8]}"
    df = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    tables.save_layer(df.where("c_custkey % 2 = 0"), name)
    return tables.save_layer(df, name)


def _replaced(s, d):
    """Layers on customers; replacing the base rebuilds what was built on it."""
    c = Catalogue(s, f"replaced_{uuid.uuid4().hex[:8]}")
    rows = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    c.define("customers", lambda: rows)
    c.define("segments", lambda base: base.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("top")), ["customers"])
    c.define("rich_segments", lambda seg: seg.where("top > 9000"), ["segments"], view=True)
    c.define("shares", lambda seg: seg.select("c_mktsegment", "customers", (F.col("customers") * 2).alias("doubled")), ["segments"])
    c.build()
    c.replace("customers", rows.where("c_acctbal > 0"))
    return c.table("shares").join(c.table("rich_segments").select("c_mktsegment", "top"), "c_mktsegment", "left")


def _layer_counts(s, d):
    """Every layer of green space, occupation, density and shadow."""
    return layers.catalogue(s, d).row_counts([
        "urban_building_base", "buildings_clean", "parcels_clean", "building_parcel_intersections", "building_parcel_coverage",
        "parcel_fos", "building_far_estimate", "parcel_far", "building_height_points", "green_areas_near_model",
        "buildings_near_green", "high_buildings_near_green", "shadow_risk_green", "high_shadow_risk_green",
    ])


def _advice(s, d):
    path = _folder(s)
    vector.write_advice(advice.advise(city.store(s, d), {"command": "advise"}), path)
    return s.read.schema("max_features int, objectclasses array<struct<name:string,properties:array<string>>>").json(path).select(
        "max_features", F.explode("objectclasses").alias("c")
    ).select("max_features", "c.name")


def _upgraded(s, d):
    old = city.property_rows(s, d).withColumn("datatype_id", F.when(F.col("name") != "storeys", F.col("datatype_id").cast("decimal(10,0)")))
    log = table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("ts")).alias("transaction_date"))
    up = tables.upgrade_tables({"property": old, "feature_changelog": log})
    a = up["property"].groupBy("datatype_id").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("type "), F.col("datatype_id").cast("string")).alias("what"), "n")
    b = up["feature_changelog"].agg(F.count_if(F.year("transaction_date") == 1).alias("n")).select(F.lit("year one").alias("what"), "n")
    return a.unionByName(b)


COUNTS_SQL = (
    "SELECT 'urban_building_base' AS layer, count(*) AS rows FROM base UNION ALL SELECT 'buildings_clean', count(*) FROM base UNION ALL "
    "SELECT 'parcels_clean', count(*) FROM clean_parcels UNION ALL "
    "SELECT 'building_parcel_intersections', count(*) FROM pieces UNION ALL SELECT 'building_parcel_coverage', count(*) FROM pieces WHERE parcel_rank = 1 UNION ALL "
    "SELECT 'parcel_fos', count(*) FROM fos UNION ALL SELECT 'building_far_estimate', count(*) FROM estimates UNION ALL SELECT 'parcel_far', count(*) FROM far UNION ALL "
    "SELECT 'building_height_points', count(*) FROM pts UNION ALL SELECT 'green_areas_near_model', count(*) FROM near_greens UNION ALL "
    "SELECT 'buildings_near_green', count(*) FROM near_pts UNION ALL "
    "SELECT 'high_buildings_near_green', count(*) FROM near_pts WHERE height_m >= 25 AND distance_to_green_m <= 100 UNION ALL "
    "SELECT 'shadow_risk_green', count(*) FROM shadows UNION ALL SELECT 'high_shadow_risk_green', count(*) FROM shadows WHERE shadow_risk_level IN ('HIGH', 'VERY_HIGH')"
)

ENTRIES = {
    "read_city_tables": (
        _city_tables,
        oracle(
            "SELECT 'feature' AS layer, count(*) AS rows FROM features UNION ALL SELECT 'property', count(*) FROM properties UNION ALL SELECT 'geometry_data', count(*) FROM geometries "
            "UNION ALL SELECT 'appearance', count(*) FROM appearances UNION ALL SELECT 'tex_image', count(*) FROM textures UNION ALL SELECT 'objectclass', count(*) FROM objectclass",
            "features", "properties", "geometries", "appearances", "textures", "objectclass",
        ),
    ),
    "read_city_table_values": (
        _table_values,
        oracle(
            " UNION ALL ".join(
                f"SELECT '{n}' AS tab, CAST({k} AS BIGINT) AS k, CAST({v} AS VARCHAR) AS v FROM {_VALUE_SOURCES[n]}" for n, (k, v) in _VALUES.items()
            ),
            *[x for x in _VALUE_SOURCES.values() if not x.startswith("(")],
        ),
    ),
    "read_citygml": (
        _gml,
        oracle(
            f"SELECT 'B' || k AS objectid, height_m AS height, CAST((x1 - x0) * (y1 - y0) + {layers.ARM_AREA} AS DOUBLE) AS area, "
            "CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS surfaces FROM buildings", "buildings",
        ),
    ),
    "read_feature_collection": (
        _feature_collection,
        oracle("SELECT id, 'p' || id AS name, 4326 AS srid, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM parcels", "parcels"),
    ),
    "read_material_rules": (
        _rules_csv,
        "SELECT row_number() OVER (ORDER BY p_brand, p_type) AS id, p_brand AS classname, p_type AS property_value, true AS no_colour FROM (SELECT DISTINCT p_brand, p_type FROM part)",
    ),
    "save_layer": (_saved, "SELECT c_custkey, c_mktsegment FROM customer"),
    "replace_layer": (
        _replaced,
        "SELECT c_mktsegment, count(*) AS customers, count(*) * 2 AS doubled, CASE WHEN max(c_acctbal) > 9000 THEN max(c_acctbal) END AS top "
        "FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment",
    ),
    "define_view": (
        lambda s, d: tables.define_view(table(s, d, "customer").where("c_acctbal > 9000").select("c_custkey", "c_acctbal"), "rich_customers"),
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000",
    ),
    "assert_unique_key": (
        lambda s, d: duplicate_keys(table(s, d, "orders"), "o_orderkey"),
        "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1",
    ),
    "duplicate_keys": (
        lambda s, d: duplicate_keys(table(s, d, "orders"), "o_custkey"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    ),
    "write_geojson_layer": (
        lambda s, d: _published(s, d).select("id", round_numeric(G.st_area("geom"), 2).alias("area"), round_numeric(G.st_bbox("geom")["xmin"] - 25490000.0, 2).alias("x0")),
        oracle("SELECT id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(x0 AS DOUBLE) AS x0 FROM parcels", "parcels"),
    ),
    "layer_row_counts": (
        _layer_counts,
        oracle(f"WITH {layers.SHADOW_CTES}, {layers.NEAR_PTS}, {layers.PIECES}, {layers.FOS}, {layers.FAR} {COUNTS_SQL}", "surfaces", "greens", "parcels"),
    ),
    "layer_extent": (
        lambda s, d: tables.layer_extent(city.parcels(s, d)),
        oracle("SELECT CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin, CAST(max(x1) AS DOUBLE) AS xmax, CAST(max(y1) AS DOUBLE) AS ymax FROM parcels", "parcels"),
    ),
    "write_advice": (
        _advice,
        oracle(
            "SELECT DISTINCT 2000 AS max_features, o.classname AS name FROM geometries g JOIN features f ON f.id = g.feature_id JOIN objectclass o ON o.id = f.objectclass_id",
            "geometries", "features", "objectclass",
        ),
    ),
    "assign_ids": (
        lambda s, d: assign_ids(table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"]),
        "SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey, s_name FROM supplier",
    ),
    "upgrade_tables": (
        _upgraded,
        oracle(
            "SELECT 'type ' || CASE WHEN name = 'storeys' THEN 1 ELSE datatype_id END AS what, count(*) AS n FROM properties GROUP BY 1 UNION ALL "
            "SELECT 'year one', count(*) FROM events WHERE event_type = 'view'", "properties",
        ),
    ),
}
