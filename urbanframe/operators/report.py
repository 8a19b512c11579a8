"""Store report: counts, extents, themes, levels of detail and generic attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.projection import st_transform
from urbanframe.schema import WGS84
from urbanframe.session import cut_lineage, side_by_side

# Fixed geometry type names of the part tree codes 1 to 11.
GEOMETRY_TYPES = {
    1: "Point", 2: "MultiPoint", 3: "LineString", 4: "MultiLineString", 5: "Polygon", 6: "CompositeSurface",
    7: "TriangulatedSurface", 8: "MultiSurface", 9: "Solid", 10: "CompositeSolid", 11: "MultiSolid",
}
GENERIC_NAMESPACE = "gen"


def _features(store) -> DataFrame:
    oc = store["objectclass"].select(F.col("id").alias("objectclass_id"), "classname", "is_toplevel", "namespace_id")
    uri = F.col("namespace") if "namespace" in store["namespace"].columns else F.lit(None)
    ns = store["namespace"].select(F.col("id").alias("namespace_id"), "alias", uri.cast("string").alias("uri"))
    dict_ = oc.join(ns, "namespace_id", "left")
    live = F.col("termination_date").isNull()
    return store["feature"].join(dict_, "objectclass_id", "left").select(
        "id", "envelope", F.concat_ws(":", "alias", "classname").alias("type"), "alias", "uri",
        (F.col("is_toplevel") == 1).alias("top"), live.alias("live"),
    )


def _counts(store: dict[str, DataFrame], active_only: bool) -> dict[str, DataFrame]:
    """One grouped pass over each table; every result has a few rows per class, level, theme or attribute."""
    f = _features(store)
    n = F.count(F.lit(1)).alias("active")
    scope = (f.where("live") if active_only else f).select(F.col("id").alias("feature_id"))
    geo = store["geometry_data"].where(F.col("geometry").isNotNull()).join(scope, "feature_id", "left_semi")
    codes = F.create_map(*[F.lit(x) for kv in GEOMETRY_TYPES.items() for x in kv])
    kind = F.try_element_at(codes, F.get_json_object("geometry_properties", "$.type").cast("int"))
    ns = store["namespace"].select(F.col("id").alias("namespace_id"), (F.col("alias") == GENERIC_NAMESPACE).alias("generic"))
    dt = store["datatype"].select(F.col("id").alias("datatype_id"), "typename")
    told = store["property"].select("feature_id", "namespace_id", "datatype_id", "name", "val_lod").join(ns, "namespace_id", "left")
    told = told.where("generic OR val_lod IS NOT NULL").join(dt, "datatype_id", "left")
    told = told.join(scope.withColumn("inside", F.lit(True)), "feature_id", "left")
    attribute = F.when(F.col("generic"), F.concat_ws("/", "name", "typename")).alias("attribute")
    level = F.when(F.col("inside"), F.col("val_lod")).alias("lod")
    mapping = store["surface_data_mapping"]
    mapped = {"materialMappings": "material_mapping", "textureMappings": "texture_mapping", "georeferencedMappings": "georeferenced_texture_mapping"}
    found = {
        "feature": f.groupBy("type", "alias", "uri", "top").agg(n, F.count_if("live").alias("live")),
        "geometry": geo.groupBy(kind.alias("kind")).agg(n),
        # both questions in one pass: a set of rows by level and one by attribute
        "property": told.select(level, attribute).groupingSets([[F.col("lod")], [F.col("attribute")]], "lod", "attribute").agg(n),
        "appearance": store["appearance"].groupBy("theme", "is_global").agg(n),
        "mapping": mapping.agg(*[F.count(c).alias(k) for k, c in mapped.items()]),
    }
    if "codelist" in store:
        entries = store["codelist_entry"].groupBy(F.col("codelist_id").alias("id")).agg(n)
        found["codelist"] = store["codelist"].join(entries, "id", "left").groupBy("codelist_type", "url").agg(F.sum(F.coalesce("active", F.lit(0))).alias("active"))
    return dict(zip(found, side_by_side(*[lambda df=df: cut_lineage(df) for df in found.values()])))


def city_report(store: dict[str, DataFrame], active_only: bool = True) -> DataFrame:
    """Report as rows (section, name, active, terminated); plain counts use ``active``.

    Sections topLevelFeatures, lods, themes, modules and codeLists name what the store
    holds: ``active`` is then how often. Each table is read once; a store without code
    lists has none.
    """
    c = _counts(store, active_only)
    f, live, ended = c["feature"], F.sum("live"), F.sum(F.col("active") - F.col("live"))
    blocks = []

    def rows(section: str, df: DataFrame, active: Column | str = "active", name: Column | None = None, terminated: Column | None = None) -> None:
        """One row in all, or one for each name."""
        sums = [F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in (
            (F.sum(active) if isinstance(active, str) else active, "active"), (F.lit(0) if terminated is None else terminated, "terminated"))]
        got = df.agg(*sums).withColumn("name", F.lit("")) if name is None else df.groupBy(name.alias("name")).agg(*sums)
        blocks.append(got.select(F.lit(section).alias("section"), "name", "active", "terminated"))

    def counted(section: str, table: str) -> None:
        rows(section, store[table].agg(F.count(F.lit(1)).alias("active")))

    rows("featureCount", f, live, None, ended)
    rows("topLevelFeatureCount", f.where("top"), live, None, ended)
    rows("byType", f, live, F.col("type"), ended)
    rows("geometryCount", c["geometry"])
    rows("geometryByType", c["geometry"], name=F.col("kind"))
    levels = c["property"].where("lod IS NOT NULL")
    rows("geometryByLod", levels, name=F.col("lod"))
    counted("implicitGeometryCount", "implicit_geometry")
    counted("addressCount", "address")
    rows("appearanceCount", c["appearance"])
    rows("appearanceByTheme", c["appearance"], name=F.col("theme"))
    rows("globalAppearances", c["appearance"].where("is_global = 1"))
    for section in ("materialMappings", "textureMappings", "georeferencedMappings"):
        rows(section, c["mapping"], section)
    rows("genericAttributes", c["property"].where("attribute IS NOT NULL"), name=F.col("attribute"))
    here = f.where("live > 0") if active_only else f
    rows("topLevelFeatures", here.where("top"), live if active_only else "active", F.col("type"))
    rows("lods", levels, name=F.col("lod"))
    rows("themes", c["appearance"].where("theme IS NOT NULL"), name=F.col("theme"))
    rows("modules", here.where("alias IS NOT NULL"), live if active_only else "active", F.concat_ws("=", "alias", "uri"))
    if "codelist" in c:
        rows("codeLists", c["codelist"], name=F.concat_ws("=", "codelist_type", "url"))
    return reduce(DataFrame.unionByName, blocks)


def report_extent(store: dict[str, DataFrame], active_only: bool = True) -> DataFrame:
    """3D extent of all features and its corners in degrees."""
    f = store["feature"]
    if active_only:
        f = f.where(F.col("termination_date").isNull())
    box = f.select(G.st_bbox("envelope").alias("_b"), F.col("envelope.srid").alias("_s")).where("_b is not null")
    one = box.agg(G.extent_agg(F.col("_b")).alias("extent"), F.min("_s").alias("srid"))
    corners = G.st_rectangle(F.col("extent.xmin"), F.col("extent.ymin"), F.col("extent.xmax"), F.col("extent.ymax"), srid=F.col("srid"))
    return one.withColumn("wgs84", G.st_bbox(st_transform(corners, WGS84))).select(
        "extent", "srid", F.array("wgs84.xmin", "wgs84.ymin", "wgs84.xmax", "wgs84.ymax").alias("wgs84_extent")
    )


def city_report_json(store: dict[str, DataFrame], active_only: bool = True) -> DataFrame:
    """The report as one JSON document (size set by names, not by data): summary, code lists, modules, and all rows."""
    rows = city_report(store, active_only)
    one = F.struct("section", "name", "active", "terminated")
    names = lambda section: F.array_sort(F.collect_list(F.when(F.col("section") == section, F.col("name"))))
    body = rows.agg(
        F.array_sort(F.collect_list(one)).alias("rows"), *[names(s).alias(s) for s in ("topLevelFeatures", "lods", "themes", "modules", "codeLists")]
    )
    pairs = lambda c: F.transform(c, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.substring_index(x, "=", -1).alias("v")))
    lists = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(pairs("codeLists"), lambda p: p["k"])),
        lambda k: F.struct(k, F.transform(F.filter(pairs("codeLists"), lambda p: p["k"] == k), lambda p: p["v"])),
    ))
    extent = report_extent(store, active_only).select(F.struct("extent", "srid", "wgs84_extent")).scalar()
    e = F.col("_e")
    crs = F.struct(e["srid"].alias("srid"), F.concat(F.lit("EPSG:"), e["srid"].cast("string")).alias("identifier"))
    corners = F.array(*[e["extent"][c] for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")])
    summary = F.struct("topLevelFeatures", "lods", "themes", crs.alias("crs"), corners.alias("extent"), e["wgs84_extent"].alias("wgs84Extent"))
    doc = F.struct(summary.alias("summary"), lists.alias("codeLists"), F.map_from_entries(pairs("modules")).alias("modules"), F.col("rows"))
    return body.withColumn("_e", extent).select(F.to_json(doc).alias("report"))
