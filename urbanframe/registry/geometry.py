"""Geometry column functions on derived rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions import projection as P
from urbanframe.functions.scalars import round_numeric
from urbanframe.registry import city
from urbanframe.registry.city import oracle
from urbanframe.registry.layers import R


def _rects(s, d):
    """Building rectangles as slanted 3D polygons, with a second rectangle each."""
    b = city.relation(s, d, "buildings")
    c = {n: F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1", "z")}
    box = G.bbox_struct(c["x0"], c["y0"], c["x1"], c["y1"], c["z"], c["z"] + F.col("height_m"))
    return b.select(
        "k", "x0", "y0", "x1", "y1", "z", "height_m", G.slanted_envelope(box).alias("g"),
        G.st_rectangle(c["x0"] + 3, c["y0"] + 2, c["x0"] + 15, c["y0"] + 9).alias("h"),
        G.st_rectangle(c["x1"] + 5, c["y1"] + 12, c["x1"] + 9, c["y1"] + 20).alias("far"),
    )


def _e(cols, *names):
    return lambda s, d: _rects(s, d).select("k", *cols())


def _o(cols):
    return oracle(f"SELECT k, {cols} FROM buildings", "buildings")


D = "CAST({} AS DOUBLE)".format
OX = "greatest(0, least(x1, x0 + 15) - greatest(x0, x0 + 3))"
OY = "greatest(0, least(y1, y0 + 9) - greatest(y0, y0 + 2))"
AREA = "(x1 - x0) * (y1 - y0)"


def _flat(fields, g):
    return [G.st_bbox(g)[f].alias(f) for f in fields]


def _lonlat(s, d):
    """Building corners placed around the projection's central meridian."""
    b = city.relation(s, d, "buildings")
    return b.select("k", G.st_point(F.col("x0") + 25490000.0, F.col("y0") + 6670000.0).alias("m"))


def _round_trip(s, d):
    back = P.st_transform(P.st_transform("m", 4326), 3879)
    return _lonlat(s, d).select(
        "k", (F.abs(G.st_x(back) - G.st_x("m")) < 0.001).alias("x_ok"), (F.abs(G.st_y(back) - G.st_y("m")) < 0.001).alias("y_ok")
    )


def _hull_area(s, d):
    g = G.st_collect_pair("g", "far")
    return _rects(s, d).select("k", round_numeric(G.st_area(K.st_convexhull(g)), 3).alias("area"))


# Hull of two rectangles, the second up and to the right: the joint bounding box without the two cut corners.
# Lower right: from (x1, y0) to (x1 + 9, y1 + 12). Upper left: from (x0, y1) to (x1 + 5, y1 + 20).
HULL = (
    "(x1 + 9 - x0) * (y1 + 20 - y0) - (9 * (y1 + 12 - y0)) / 2.0 - ((x1 + 5 - x0) * 20) / 2.0"
)

ENTRIES = {
    "st_area": (_e(lambda: [G.st_area("g").alias("area")]), _o(f"{D(AREA)} AS area")),
    "st_bbox": (
        _e(lambda: _flat(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), "g")),
        _o(f"{D('x0')} AS xmin, {D('y0')} AS ymin, {D('z')} AS zmin, {D('x1')} AS xmax, {D('y1')} AS ymax, z + height_m AS zmax"),
    ),
    "st_envelope": (
        _e(lambda: [G.st_area(G.st_envelope(G.st_collect_pair("g", "far"))).alias("area"), G.st_npoints(G.st_envelope("g")).alias("n")]),
        _o(f"{D('(x1 + 9 - x0) * (y1 + 20 - y0)')} AS area, 5 AS n"),
    ),
    "st_height": (_e(lambda: [G.st_height("g").alias("height")]), _o("(z + height_m) - z AS height")),
    "st_centroid": (
        _e(lambda: [G.st_x(G.st_centroid_of_envelope("g")).alias("x"), G.st_y(G.st_centroid_of_envelope("g")).alias("y")]),
        _o("(x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y"),
    ),
    "st_bbox_center_point": (
        _e(lambda: [G.st_x(G.bbox_center(G.st_bbox("far"))).alias("x"), G.srid_of(G.st_setsrid(G.bbox_center(G.st_bbox("far")), 4326)).alias("srid")]),
        _o("(x1 + 5 + x1 + 9) / 2.0 AS x, 4326 AS srid"),
    ),
    "st_npoints": (_e(lambda: [G.st_npoints(G.st_collect_pair("g", "h")).alias("n")]), _o("10 AS n")),
    "st_geometrytype": (_e(lambda: [G.st_geometrytype("g").alias("kind")]), _o("'Polygon' AS kind")),
    "st_force2d": (
        _e(lambda: _flat(("zmin", "zmax", "xmax"), G.st_force2d("g"))), _o(f"{D('0')} AS zmin, {D('0')} AS zmax, {D('x1')} AS xmax"),
    ),
    "st_multi": (_e(lambda: [G.st_geometrytype(G.st_multi("g")).alias("kind"), G.st_area(G.st_multi("g")).alias("area")]), _o(f"'MultiPolygon' AS kind, {D(AREA)} AS area")),
    "st_collectionextract3": (
        _e(lambda: [
            F.size(G.polygons_only(G.st_collect_pair("g", G.st_makeline(F.array(G.make_point(0, 0), G.make_point(F.col("x1"), 1.0)))))["parts"]).alias("parts"),
        ]),
        _o("1 AS parts"),
    ),
    "st_forcecollection": (
        _e(lambda: [
            G.st_geometrytype(G.st_forcecollection(G.geometry("PolyhedralSurface", F.col("g.parts"), 3879))).alias("kind"),
            G.st_geometrytype(G.st_forcecollection(F.col("g"))).alias("kept"),
        ]),
        _o("'GeometryCollection' AS kind, 'Polygon' AS kept"),
    ),
    "st_setsrid": (_e(lambda: [G.srid_of(G.st_setsrid("g", 4326)).alias("srid")]), _o("4326 AS srid")),
    "st_srid": (_e(lambda: [G.srid_of("g").alias("srid")]), _o("3879 AS srid")),
    "st_xyz": (
        _e(lambda: [G.st_x("g").alias("x"), G.st_y("g").alias("y"), G.st_z("g").alias("z")]), _o(f"{D('x0')} AS x, {D('y0')} AS y, {D('z')} AS z"),
    ),
    "st_affine": (
        _e(lambda: _flat(("xmin", "ymin", "zmax"), G.st_affine("g", [F.lit(float(v)) for v in (2, 0, 0, 0, 3, 1, 0, 0, 1, 10, 20, 30)]))),
        _o(f"{D('2 * x0 + 10')} AS xmin, 3 * y0 + z + 20.0 AS ymin, z + height_m + 30 AS zmax").replace("3 * y0 + z + 20.0 AS ymin", "CAST(3 * y0 + z + 20 AS DOUBLE) AS ymin"),
    ),
    "st_translate": (
        _e(lambda: _flat(("xmin", "ymax"), G.st_translate("g", F.col("z"), -5.0))), _o(f"{D('x0 + z')} AS xmin, {D('y1 - 5')} AS ymax"),
    ),
    "st_makeline": (
        _e(lambda: [G.st_npoints(G.st_makeline(G.points_of("g"))).alias("n"), G.st_geometrytype(G.st_makeline(G.points_of("g"))).alias("kind")]),
        _o("5 AS n, 'LineString' AS kind"),
    ),
    "st_makepolygon": (_e(lambda: [G.st_area(G.st_makepolygon(F.col("g.parts")[0][0])).alias("area")]), _o(f"{D(AREA)} AS area")),
    "st_distance": (
        _e(lambda: [round_numeric(K.st_distance("g", "far"), 4).alias("apart"), K.st_distance("g", "h").alias("touching")]),
        _o(f"{R('sqrt(25 + 144.0)', 4)} AS apart, {D('0')} AS touching") .replace("FROM buildings", "FROM buildings WHERE y1 - y0 >= 2"),
    ),
    "st_dwithin": (
        _e(lambda: [K.st_dwithin("g", "far", F.col("height_m")).alias("near")]), _o("13.0 <= height_m AS near"),
    ),
    "st_intersects": (
        _e(lambda: [K.st_intersects(F.col("g"), G.st_translate("h", F.col("z") * 3.0, 0.0)).alias("hit")]),
        _o("(x1 >= x0 + 3 + z * 3 AND x0 <= x0 + 15 + z * 3 AND y1 >= y0 + 2) AS hit"),
    ),
    "st_intersection": (
        _e(lambda: [G.st_area(K.st_intersection("g", "h")).alias("area"), K.st_intersection_area("g", "h").alias("same")]),
        _o(f"{D(f'{OX} * {OY}')} AS area, {D(f'{OX} * {OY}')} AS same"),
    ),
    "st_unaryunion": (
        _e(lambda: [G.st_area(K.st_unaryunion(G.st_collect_pair("g", "h"))).alias("area")]), _o(f"{D(f'{AREA} + 84 - {OX} * {OY}')} AS area"),
    ),
    "st_union": (
        _e(lambda: [K.st_covered_area(G.st_collect_pair("g", "h")).alias("area")]), _o(f"{D(f'{AREA} + 84 - {OX} * {OY}')} AS area"),
    ),
    "st_makevalid": (
        # a bow tie: two triangles that meet in the middle
        lambda s, d: _rects(s, d).select("k", G.st_area(K.st_makevalid(G.st_makepolygon(F.array(
            G.make_point(F.col("x0"), F.col("y0")), G.make_point(F.col("x1"), F.col("y1")), G.make_point(F.col("x1"), F.col("y0")),
            G.make_point(F.col("x0"), F.col("y1")), G.make_point(F.col("x0"), F.col("y0")),
        )))).alias("area")).withColumn("area", round_numeric("area", 4)),
        _o(f"{D(f'{AREA} / 2.0')} AS area"),
    ),
    "st_convexhull": (_hull_area, _o(f"{R(HULL, 3)} AS area")),
    "st_buffer": (
        # inside the round-cornered 10 m buffer of the rectangle
        _e(lambda: [K.st_dwithin("far", G.st_envelope("g"), 13.0).alias("inside"), K.st_dwithin("far", G.st_envelope("g"), 12.9).alias("outside")]),
        _o("true AS inside, false AS outside"),
    ),
    "st_isempty": (
        _e(lambda: [
            G.st_isempty("g").alias("full"),
            G.st_isempty(K.st_intersection("g", "far")).alias("apart"),
        ]),
        _o("false AS full, true AS apart"),
    ),
    "st_collect_pair": (
        _e(lambda: [F.size(G.st_collect_pair("g", "h")["parts"]).alias("two"), F.size(G.st_collect_pair(F.lit(None).cast("struct<srid:int,kind:string,parts:array<array<array<struct<x:double,y:double,z:double>>>>>"), F.col("h"))["parts"]).alias("one")]),
        _o("2 AS two, 1 AS one"),
    ),
    "st_pointonsurface": (
        lambda s, d: _rects(s, d).withColumn("p", K.st_pointonsurface(G.st_collect_pair("g", "far"))).select(
            "k", G.contains_point(G.st_collect_pair("g", "far"), G.st_x("p"), G.st_y("p")).alias("inside")
        ),
        _o("true AS inside"),
    ),
    "st_transform": (_round_trip, _o("true AS x_ok, true AS y_ok")),
    "reproject_layer": (
        lambda s, d: _lonlat(s, d).select(
            "k", G.srid_of(P.change_srid("m", 4326, True)).alias("moved"), (G.st_x(P.change_srid("m", 4326, True)) < 30).alias("degrees"),
            G.srid_of(P.change_srid("m", 4326)).alias("relabelled"), (G.st_x(P.change_srid("m", 4326)) > 1000).alias("metres"),
            G.srid_of(P.change_srid("m", None)).alias("kept"), G.srid_of(P.change_srid(G.st_setsrid("m", 0), 4326)).alias("zero"),
        ),
        _o("4326 AS moved, true AS degrees, 4326 AS relabelled, true AS metres, 3879 AS kept, 0 AS zero"),
    ),
}
