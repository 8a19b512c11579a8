"""GeoJSON layers, CityGML members, material rule files, advice documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.functions import geometry as G
from urbanframe.functions.projection import st_transform
from urbanframe.operators.envelopes import boxes_upwards
from urbanframe.operators.materials import RULE_COLUMNS
from urbanframe.schema import GEOMETRY_DDL, METRIC, WGS84
from urbanframe.session import cut_lineage, spread

_PAIR = "array<double>"


# ---------------------------------------------------------------- GeoJSON
def _vertex(p: Column) -> Column:
    return G.make_point(p[0], p[1], F.coalesce(F.try_element_at(p, F.lit(3)), F.lit(0.0)))


def _geojson_parts(text: Column, depth: int) -> Column:
    """Parts of any GeoJSON geometry; collections are opened ``depth`` times."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")

    def parsed(depth: int) -> Column:
        ddl = _PAIR
        for _ in range(depth):
            ddl = f"array<{ddl}>"
        return F.from_json(coords, ddl)

    def ring(r: Column) -> Column:
        return F.transform(r, _vertex)

    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(_vertex(parsed(0))))))
        .when(kind == "MultiPoint", F.transform(parsed(1), lambda p: F.array(F.array(_vertex(p)))))
        .when(kind == "LineString", F.array(F.array(ring(parsed(1)))))
        .when(kind == "MultiLineString", F.transform(parsed(2), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(parsed(2), ring)))
        .when(kind == "MultiPolygon", F.transform(parsed(3), lambda poly: F.transform(poly, ring)))
    )
    if depth:
        members = F.from_json(F.get_json_object(text, "$.geometries"), "array<string>")
        parts = parts.when(kind == "GeometryCollection", F.flatten(F.transform(members, lambda m: _geojson_parts(m, depth - 1))))
    return parts


def geojson_geometry(text: Column, srid: int) -> Column:
    """Geometry from GeoJSON text: points, lines, polygons, their multi kinds, and collections of them (also nested once)."""
    parts = _geojson_parts(text, 2)
    wrong = F.raise_error(F.concat(F.lit("no geometry that can be read: "), F.substring(text, 1, 200))).cast(GEOMETRY_DDL)
    given = text.isNotNull() & (F.trim(text) != "null")
    return F.when(parts.isNotNull(), G.geometry(F.get_json_object(text, "$.type"), parts, srid)).when(given, wrong)


def to_geojson(g) -> Column:
    """GeoJSON text of a geometry; polygons become MultiPolygon, other kinds keep theirs.

    A collection of polygons is a MultiPolygon as well; one that holds points or
    lines stays a collection of its parts.
    """
    g = F.col(g) if isinstance(g, str) else g
    xy = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    kind = g["kind"]

    def text(name: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates")))

    def is_polygon(part: Column) -> Column:
        ring = part[0]
        return (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1))

    def single(part: Column) -> Column:
        return F.when(is_polygon(part), text("Polygon", part)).when(F.size(part[0]) == 1, text("Point", part[0][0])).otherwise(text("LineString", part[0]))

    mixed = (kind == "GeometryCollection") & F.exists(xy, lambda p: ~is_polygon(p))
    members = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(xy, single), ","), F.lit("]}"))
    return (
        F.when(kind == "Point", text("Point", xy[0][0][0])).when(kind == "LineString", text("LineString", xy[0][0]))
        .when(kind == "MultiPoint", text("MultiPoint", F.transform(xy, lambda p: p[0][0])))
        .when(kind == "MultiLineString", text("MultiLineString", F.transform(xy, lambda p: p[0])))
        .when(mixed, members).otherwise(text("MultiPolygon", xy))
    )


# What a line of a collection may hold besides a feature: brackets, and the members writers put in its head.
_FRAME = r'^[{}\[\]]*$|^\{?\s*"(type"\s*:\s*"FeatureCollection"|(name|description|crs|bbox|features|xy_coordinate_resolution|totalFeatures|numberMatched|numberReturned|timeStamp)"\s*:)'


# Lines of a document with one feature a line, beside these: nothing else may be opened or closed there.
_STRICT_FRAME = (
    r'^$|^[{}\]]$|^\]\s*\}$|^\{?\s*"type"\s*:\s*"FeatureCollection"(\s*,\s*"features"\s*:\s*\[)?$|^"features"\s*:\s*\[$'
    r'|^"(name|description)"\s*:\s*"[^"\\]*"$|^"crs"\s*:\s*\{[^\[\]]*\}$'
)


def _feature_a_line(lines: DataFrame, one: str) -> bool:
    """Is every line of the documents frame or exactly one whole feature?"""
    v = F.col("value")
    # as array element and as member: only one whole value is both
    whole = F.try_parse_json(F.concat(F.lit("["), v, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"f":'), v, F.lit("}"))).isNotNull()
    feature = v.startswith("{") & (F.from_json(v, one)["type"] == "Feature") & whole
    return lines.agg(F.count_if(~F.coalesce(v.rlike(_STRICT_FRAME) | feature, F.lit(False)))).first()[0] == 0


def read_feature_collection(
    spark: SparkSession, path: str, properties: str, srid: int = METRIC, target: int | None = WGS84, key: str = "id",
    by_line: bool = False,
) -> DataFrame:
    """A FeatureCollection as a layer: lower-case columns, key, geometry reprojected.

    ``properties`` is the DDL of the property columns; the schema is declared,
    never inferred. By default each file is one document; where all of them have
    one feature a line (as the layer writer and most others put them), files of any
    size are split among tasks, other layouts are read by one task a file. With
    ``by_line`` features must stand on their own lines.
    """
    one = f"struct<type:string, properties:struct<{properties}>, geometry:string>"
    text = F.regexp_replace("value", r"^[,\s\ufeff]+|[,\s]+$", "")
    lines = spark.read.text(path).select(text.alias("value"))
    if by_line:
        # an opening line ends inside the collection; whatever is no frame must be a feature
        frame = F.col("value").rlike(_FRAME) & ~(F.col("value").contains('"Feature"') & F.col("value").startswith("{"))
        f = lines.where(~frame).select(F.from_json("value", one).alias("f"), "value")
        # a line that cannot be parsed has no type either
        wrong = F.raise_error(F.concat(F.lit("by_line: a line is no feature: "), F.substring("value", 1, 200))).cast("boolean")
        f = f.where(F.when(F.col("f.type") == "Feature", True).otherwise(wrong))
    elif _feature_a_line(lines, one):
        f = lines.where(~F.col("value").rlike(_STRICT_FRAME)).select(F.from_json("value", one).alias("f"))
    else:
        doc = spark.read.schema(f"type string, features array<{one}>").option("multiLine", True).json(path)
        f = doc.select(F.explode("features").alias("f"))
    flat = f.select("f.properties.*", F.col("f.geometry").alias("_json"))
    flat = flat.toDF(*[c.lower() for c in flat.columns])
    flat = flat.withColumn("geom", geojson_geometry(F.col("_json"), srid)).drop("_json")
    if target and target != srid:
        flat = flat.withColumn("geom", st_transform("geom", target))
    return flat.withColumn("bbox", G.st_bbox("geom")).where(F.col(key).isNotNull())


def feature_lines(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature text per row, in degrees."""
    attributes = [c for c in df.columns if c not in (geom, "bbox")]
    # bound once: written in place, the projection would be computed for every mention of its result
    shape = _bound(st_transform(F.col(geom), WGS84), to_geojson)
    head = F.lit('{"type":"Feature","geometry":')
    return df.select(
        F.concat(head, F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*attributes)), F.lit("}")).alias("value")
    )


def write_framed(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """Text files that each start with a head line and end with a tail line."""

    def framed(batches):
        import pyarrow as pa

        def one(text):
            return pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["value"])

        yield one(head)
        yield from batches
        yield one(tail)

    lines.select("value").mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_geojson_layer(df: DataFrame, path: str, geom: str = "geom") -> None:
    """Publish a layer: every part file is one valid FeatureCollection, written in parallel."""
    comma = F.when(F.col("_first"), F.lit("")).otherwise(F.lit(","))
    lines = feature_lines(spread(df), geom).withColumn("_m", F.monotonically_increasing_id())
    lines = lines.withColumn("_first", F.col("_m").bitwiseAND((1 << 33) - 1) == 0).select(F.concat(comma, "value").alias("value"))
    write_framed(lines, path, '{"type":"FeatureCollection","features":[', "]}")


# ---------------------------------------------------------------- CityGML
# Fixed names: thematic surfaces, levels of detail, levels of building parts that are followed.
SURFACE_TAGS = (
    "GroundSurface", "RoofSurface", "WallSurface", "ClosureSurface", "FloorSurface", "InteriorWallSurface", "CeilingSurface",
    "OuterCeilingSurface", "OuterFloorSurface",
)
LODS = (1, 2, 3, 4)
PART_LEVELS = 3
_OTHER = "xs_any"  # elements the schema does not name
_RING = "struct<`gml:LinearRing`:struct<`gml:posList`:string>>"
_POLYGON = f"struct<`_gml:id`:string,`gml:exterior`:{_RING},`gml:interior`:array<{_RING}>>"
_MEMBERS = f"struct<`gml:surfaceMember`:array<struct<`gml:Polygon`:{_POLYGON},`_xlink:href`:string>>>"
_SOLID = f"struct<`gml:Solid`:struct<`gml:exterior`:struct<`gml:CompositeSurface`:{_MEMBERS}>>>"
_SHELL = f"struct<`gml:MultiSurface`:{_MEMBERS}>"
_TRIANGLES = f"struct<`gml:trianglePatches`:struct<`gml:Triangle`:array<struct<`gml:exterior`:{_RING}>>>>"


def _shapes_ddl() -> str:
    return ",".join(f"`bldg:lod{n}MultiSurface`:{_SHELL},`bldg:lod{n}Solid`:{_SOLID}" for n in LODS)


_SURFACE = f"struct<`_gml:id`:string,{_shapes_ddl()}>"


def _building_ddl(levels: int) -> str:
    bounds = ",".join(f"`bldg:{t}`:{_SURFACE}" for t in SURFACE_TAGS)
    ddl = (
        f"`_gml:id`:string,`bldg:measuredHeight`:string,{_shapes_ddl()},`bldg:boundedBy`:array<struct<{bounds},`{_OTHER}`:array<string>>>"
    )
    part = f"struct<`bldg:BuildingPart`:{_building_ddl(levels - 1)}>" if levels else "string"
    return f"struct<{ddl},`bldg:consistsOfBuildingPart`:array<{part}>>"


_TIN = f"struct<`_gml:id`:string,`dem:lod`:string,`dem:tin`:struct<`gml:TriangulatedSurface`:{_TRIANGLES},`gml:Tin`:{_TRIANGLES}>>"
_RELIEF = f"struct<`_gml:id`:string,`dem:lod`:string,`dem:reliefComponent`:array<struct<`dem:TINRelief`:{_TIN},`{_OTHER}`:array<string>>>>"
CITYGML_MEMBER_DDL = f"`bldg:Building` {_building_ddl(PART_LEVELS)}, `dem:ReliefFeature` {_RELIEF}, `{_OTHER}` array<string>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def pos_list(text: Column) -> Column:
    """Vertices of a ``posList`` (x y z triples)."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.cast("double"))

    def vertices(v: Column) -> Column:
        n = F.floor(F.size(v) / 3).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: G.make_point(v[3 * i], v[3 * i + 1], v[3 * i + 2]))

    return _bound(numbers, vertices)


def _ring(r: Column) -> Column:
    return pos_list(r["gml:LinearRing"]["gml:posList"])


def _polygons(members: Column) -> Column:
    """Parts of the polygons of surface members; members that only refer to others have none."""
    own = F.filter(members, lambda m: m["gml:Polygon"]["gml:exterior"].isNotNull())
    holes = lambda p: F.transform(F.coalesce(p["gml:interior"], F.array()), _ring)
    return F.transform(own, lambda m: F.concat(F.array(_ring(m["gml:Polygon"]["gml:exterior"])), holes(m["gml:Polygon"])))


_SHAPE_DDL = f"struct<name:string,lod:string,geometry:{GEOMETRY_DDL}>"


def _shapes(thing: Column, srid: int) -> Column:
    """Array of (name, lod, geometry): the shapes an element has."""
    found = []
    for n in LODS:
        for kind, column in (("MultiSurface", "gml:MultiSurface"), ("Solid", "gml:Solid")):
            shape = thing[f"bldg:lod{n}{kind}"][column]
            members = (shape if kind == "MultiSurface" else shape["gml:exterior"]["gml:CompositeSurface"])["gml:surfaceMember"]
            form = "MultiPolygon" if kind == "MultiSurface" else "Solid"
            geometry = _bound(_polygons(members), lambda parts, form=form: F.when(F.size(parts) > 0, G.geometry(form, parts, srid)))
            found.append(F.struct(F.lit(f"lod{n}{kind}").alias("name"), F.lit(str(n)).alias("lod"), geometry.alias("geometry")))
    return F.filter(F.array(*found), lambda s: s["geometry"].isNotNull()).cast(f"array<{_SHAPE_DDL}>")


_PARTS = "bldg:consistsOfBuildingPart"


def _apart(building: Column) -> list[Column]:
    """(thing, parts): a building without its parts, and these. Written as two columns, so that few steps read the many fields of parts."""
    return [building.dropFields(f"`{_PARTS}`").alias("thing"), building[_PARTS].alias("parts")]


def _things(df: DataFrame, classname: Column, thing: Column, owner: Column, fallback: Column, *more: Column) -> DataFrame:
    """Elements with class, owner and id; one without a gml:id is named after its owner and place."""
    rows = df.select(owner.alias("owner"), classname.alias("classname"), F.coalesce(thing["_gml:id"], fallback).alias("objectid"), thing.alias("thing"), *more)
    return rows.where("thing IS NOT NULL").withColumn("id", F.xxhash64("objectid"))


def _read_all(df: DataFrame, others: Column, what: str) -> DataFrame:
    """The rows; fails at the first element of a kind the schema does not name."""
    wrong = F.raise_error(F.concat(F.lit(f"{what} of a kind that is not read: "), F.substring(others[0], 1, 200))).cast("boolean")
    return df.where(F.when(F.coalesce(F.size(others), F.lit(0)) > 0, wrong).otherwise(True))


def _placed_name(tag: Column) -> Column:
    return F.concat_ws("_", "objectid", tag, F.col("n").cast("string"))


def _tagged(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """The elements ``tag`` of XML files of any size.

    A closing tag ends a record of the text reader, which splits files among tasks; an
    element is what stands before it from its opening tag on. Files in which these tags
    may mean something else (inside each other, in unfinished comments, CDATA sections or
    empty elements, or with white space in a closing tag) are read by one task a file.
    """
    name = re.escape(tag)
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path).select(text.alias("value"))
    start = rf"<{name}(?=[\s>/])"
    other = F.col("value").rlike(rf"<!--|<!\[CDATA\[|</{name}\s|<{name}(\s[^<>]*)?/>") | (F.regexp_count("value", F.lit(start)) > 1)
    if pieces.where(other).isEmpty():
        one = F.concat(F.regexp_extract("value", rf"(?s){start}.*", 0), F.lit(f"</{tag}>"))
        # a generator, so that a member is parsed once and not once for each of its columns
        return pieces.where(F.col("value").rlike(start)).select(F.inline(F.array(F.from_xml(one, schema, {"wildcardColName": _OTHER}))))
    return spark.read.format("xml").option("wildcardColName", _OTHER).option("rowTag", tag).schema(schema).load(path)


def read_citygml(
    spark: SparkSession, path: str, srid: int = METRIC, member_tag: str = "core:cityObjectMember", unknown: str = "fail"
) -> dict[str, DataFrame]:
    """City object members as feature, property and geometry rows (ids from the member ids), parsed in one scan.

    Read are buildings with their parts, thematic surfaces, multi surfaces and solids
    of LoD 1 to 4, and terrain, whose triangles are geometry rows of their own.
    Members of other kinds fail, or with ``unknown="list"`` are rows of the result's
    ``unread`` (the element as text). A file without members may hold bare buildings. Polygons a solid only refers to belong to the
    surface that holds them. Envelopes cover all a feature contains.
    """
    schema = T.StructType.fromDDL(CITYGML_MEMBER_DDL)
    columns = [*_apart(F.col("`bldg:Building`")), *[F.col(f"`{c}`") for c in schema.names[1:]]]
    doc = cut_lineage(_tagged(spark, path, member_tag, schema).select(columns))
    if doc.isEmpty():  # a fragment of bare buildings
        bare = _tagged(spark, path, "bldg:Building", schema["bldg:Building"].dataType)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]]
        doc = cut_lineage(bare.select(F.struct(*[F.col(f"`{c}`") for c in bare.columns]).alias("bldg:Building"), *rest).select(columns))
    if unknown == "fail":
        doc = _read_all(doc, F.col(_OTHER), "member")
    none = F.lit(None).cast("long")
    level = _things(doc, F.lit("Building"), F.col("thing"), none, F.lit("Building"), F.col("parts"))
    things = []
    for depth in range(PART_LEVELS + 1):
        parts = F.col("parts")
        if depth == PART_LEVELS:
            level = _read_all(level, parts, f"building part below level {PART_LEVELS}")
        things.append(level)
        bounds = _read_all(level.select("id", "objectid", F.posexplode(F.col("thing")["bldg:boundedBy"]).alias("n", "s")), F.col("s")[_OTHER], "surface")
        each = F.array(*[F.struct(F.lit(t).alias("tag"), F.col("s")[f"bldg:{t}"].alias("thing")) for t in SURFACE_TAGS])
        bounds = bounds.select("id", "objectid", "n", F.explode(F.filter(each, lambda e: e["thing"].isNotNull())).alias("e"))
        things.append(_things(bounds, F.col("e.tag"), F.col("e.thing"), F.col("id"), _placed_name(F.col("e.tag"))))
        if depth < PART_LEVELS:
            below = level.select("id", "objectid", F.posexplode(parts).alias("n", "p"))
            # written, so that the members are not read again for every level, and empty levels end it
            thing, more = _apart(F.col("p")["bldg:BuildingPart"])
            level = cut_lineage(_things(below, F.lit("BuildingPart"), thing, F.col("id"), _placed_name(F.lit("BuildingPart")), more))
            if level.isEmpty():
                break
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    measured = [F.col("thing")["bldg:measuredHeight"], F.lit(None)]  # buildings and parts have one, surfaces none
    # one pass over the members for all that is asked of an element
    seen = cut_lineage(union([
        t.select("id", "owner", "classname", "objectid", measured[i % 2].cast("double").alias("height"), _shapes(F.col("thing"), srid).alias("shapes"))
        for i, t in enumerate(things)
    ]))
    relief = _things(doc, F.lit("ReliefFeature"), F.col("`dem:ReliefFeature`"), none, F.lit("ReliefFeature"))
    pieces = relief.select("id", "objectid", F.posexplode(F.col("thing")["dem:reliefComponent"]).alias("n", "c"))
    pieces = _read_all(pieces, F.col("c")[_OTHER], "terrain")
    tins = _things(pieces, F.lit("TINRelief"), F.col("c")["dem:TINRelief"], F.col("id"), _placed_name(F.lit("TINRelief")))
    tin = F.col("thing")["dem:tin"]
    patches = F.coalesce(tin["gml:TriangulatedSurface"], tin["gml:Tin"])["gml:trianglePatches"]["gml:Triangle"]
    triangles = tins.select("id", "objectid", F.coalesce(F.col("thing")["dem:lod"], F.lit("0")).alias("lod"), F.posexplode(patches).alias("n", "t"))
    shapes = [seen.select("id", "objectid", F.explode("shapes").alias("s")).select("id", "objectid", "s.*"), triangles.select(
        "id", F.concat_ws("_", "objectid", F.col("n").cast("string")).alias("objectid"), F.lit("tin").alias("name"), "lod",
        G.geometry("Triangle", F.array(F.array(_ring(F.col("t")["gml:exterior"]))), srid).alias("geometry"),
    )]
    found = cut_lineage(union([t.select("id", "owner", "classname", "objectid") for t in (seen, relief, tins)]))
    # the LoD 2 surface of a feature has the feature's id, every other shape its own
    own = F.when(F.col("name") == "lod2MultiSurface", F.col("id")).otherwise(F.xxhash64("objectid", "name"))
    drawn = cut_lineage(union(shapes).withColumn("gid", own))
    held = drawn.select("id", G.st_bbox("geometry").alias("_b")).groupBy("id").agg(G.extent_agg(F.col("_b")).alias("box"))
    edges = cut_lineage(found.where("owner IS NOT NULL").select(F.col("owner").alias("id"), F.col("id").alias("child")).distinct())
    boxes = boxes_upwards(cut_lineage(found.select("id").distinct().join(held, "id", "left")), edges)
    features = found.join(boxes, "id").select("id", "classname", "objectid", G.slanted_envelope(F.col("box"), srid).alias("envelope"))
    values = {"val_feature_id": "long", "val_relation_type": "int", "val_geometry_id": "long", "val_lod": "string", "val_double": "double"}

    def rows(df: DataFrame, owner: str, name: Column, **given: Column) -> DataFrame:
        rest = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in values.items()]
        return df.select(F.col(owner).alias("feature_id"), name.alias("name"), *rest)

    linked = found.where("owner IS NOT NULL")
    role = F.when(F.col("classname") == "BuildingPart", "buildingPart").when(F.col("classname") == "TINRelief", "reliefComponent").otherwise("boundary")
    props = union([
        rows(linked, "owner", role, val_feature_id=F.col("id"), val_relation_type=F.lit(1)),
        rows(drawn, "id", F.col("name"), val_geometry_id=F.col("gid"), val_lod=F.col("lod")),
        rows(seen.where("height IS NOT NULL"), "id", F.lit("height"), val_double=F.col("height")),
    ])
    out = {"feature": features, "property": props, "geometry_data": drawn.select(F.col("gid").alias("id"), "geometry", F.col("id").alias("feature_id"))}
    return out if unknown == "fail" else {**out, "unread": doc.select(F.explode(_OTHER).alias("element"))}


# ---------------------------------------------------------------- rules and advice
def read_material_rules(spark: SparkSession, path: str, custom: str | None = None) -> DataFrame:
    """Material rules from a CSV with header; a custom file replaces the default."""
    from urbanframe.operators.ids import dense_id

    ddl = ", ".join(f"{c} string" for c in RULE_COLUMNS)
    df = spark.read.csv(custom or path, header=True, schema=ddl, nullValue="", emptyValue="")
    return dense_id(df.select([F.nullif(F.col(c), F.lit("")).alias(c) for c in RULE_COLUMNS]), list(RULE_COLUMNS), "id")


def write_advice(advice: DataFrame, path: str) -> None:
    advice.write.mode("overwrite").json(path)
