"""Geometry column functions built from Spark expressions only.

Every function takes and returns a Column and stays on the JVM side, so it can
sit in a filter or projection without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanframe.schema import BBOX_DDL, GEOMETRY_DDL, POINT_DDL


def _c(g: Column | str) -> Column:
    return F.col(g) if isinstance(g, str) else g


def _num(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def make_point(x, y, z=0.0) -> Column:
    """Coordinate struct (a vertex, not a geometry)."""
    return F.struct(_num(x).alias("x"), _num(y).alias("y"), _num(z).alias("z")).cast(POINT_DDL)


def geometry(kind: str | Column, parts: Column, srid) -> Column:
    srid = srid if isinstance(srid, Column) else F.lit(srid)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(srid.alias("srid"), kind.alias("kind"), parts.alias("parts")).cast(GEOMETRY_DDL)


def st_point(x, y, z=0.0, srid=3879) -> Column:
    return geometry("Point", F.array(F.array(F.array(make_point(x, y, z)))), srid)


def st_makeline(vertices: Column, srid=3879) -> Column:
    """Line through an array of vertices."""
    return geometry("LineString", F.array(F.array(vertices)), srid)


def st_makepolygon(ring: Column, srid=3879) -> Column:
    """Polygon from one closed ring of vertices."""
    return geometry("Polygon", F.array(F.array(ring)), srid)


def rectangle_ring(x0, y0, x1, y1, z=0.0) -> Column:
    return F.array(
        make_point(x0, y0, z), make_point(x1, y0, z), make_point(x1, y1, z),
        make_point(x0, y1, z), make_point(x0, y0, z),
    )


def st_rectangle(x0, y0, x1, y1, z=0.0, srid=3879) -> Column:
    return st_makepolygon(rectangle_ring(x0, y0, x1, y1, z), srid)


def srid_of(g) -> Column:
    return _c(g)["srid"]


def st_setsrid(g, srid) -> Column:
    g = _c(g)
    return F.when(g.isNotNull(), geometry(g["kind"], g["parts"], srid))


def st_geometrytype(g) -> Column:
    return _c(g)["kind"]


def points_of(g) -> Column:
    return F.flatten(F.flatten(_c(g)["parts"]))


def st_npoints(g) -> Column:
    g = _c(g)
    per_part = F.transform(
        g["parts"],
        lambda part: F.aggregate(part, F.lit(0), lambda n, ring: n + F.size(ring)),
    )
    return F.aggregate(per_part, F.lit(0), lambda n, m: n + m)


def st_isempty(g) -> Column:
    return F.coalesce(st_npoints(g), F.lit(0)) == 0


def not_empty(g) -> Column:
    g = _c(g)
    return g.isNotNull() & (F.size(g["parts"]) > 0)


def _extreme(pts: Column, axis: str, fn) -> Column:
    return fn(pts.getField(axis))


def st_bbox(g) -> Column:
    """Box3D as a struct of six doubles; null for an empty geometry.

    Without lambdas, so that Spark compiles it and flattens the vertices once.
    """
    pts = points_of(g)
    box = F.struct(
        *[_extreme(pts, a, F.array_min).alias(f"{a}min") for a in "xyz"],
        *[_extreme(pts, a, F.array_max).alias(f"{a}max") for a in "xyz"],
    ).cast(BBOX_DDL)
    return F.when(F.size(pts) > 0, box)


def bbox_struct(x0, y0, x1, y1, z0=0.0, z1=0.0) -> Column:
    return F.struct(
        _num(x0).alias("xmin"), _num(y0).alias("ymin"), _num(z0).alias("zmin"),
        _num(x1).alias("xmax"), _num(y1).alias("ymax"), _num(z1).alias("zmax"),
    ).cast(BBOX_DDL)


def bbox_overlaps(a: Column, b: Column) -> Column:
    """Closed 2D overlap of two bbox structs."""
    return (
        (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
    )


def bbox_expand(b: Column, r) -> Column:
    r = _num(r)
    return bbox_struct(
        b["xmin"] - r, b["ymin"] - r, b["xmax"] + r, b["ymax"] + r, b["zmin"], b["zmax"]
    )


def bbox_area(b: Column) -> Column:
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def bbox_distance(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), a["xmin"] - b["xmax"], b["xmin"] - a["xmax"])
    dy = F.greatest(F.lit(0.0), a["ymin"] - b["ymax"], b["ymin"] - a["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def bbox_height(b: Column) -> Column:
    return b["zmax"] - b["zmin"]


def bbox_min_width(b: Column) -> Column:
    return F.least(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])


def st_height(g) -> Column:
    return bbox_height(st_bbox(g))


def st_envelope(g) -> Column:
    """Axis-parallel bounding rectangle."""
    g = _c(g)
    b = st_bbox(g)
    return F.when(
        b.isNotNull(),
        st_rectangle(b["xmin"], b["ymin"], b["xmax"], b["ymax"], srid=g["srid"]),
    )


def st_centroid_of_envelope(g) -> Column:
    g = _c(g)
    b = st_bbox(g)
    return F.when(b.isNotNull(), bbox_center(b, g["srid"]))


def bbox_center(b: Column, srid=3879) -> Column:
    return st_point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2, srid=srid)


def first_vertex(g) -> Column:
    return F.try_element_at(points_of(g), F.lit(1))


def st_x(g) -> Column:
    return first_vertex(g)["x"]


def st_y(g) -> Column:
    return first_vertex(g)["y"]


def st_z(g) -> Column:
    return first_vertex(g)["z"]


def _ring_area(ring: Column) -> Column:
    """Unsigned shoelace area, relative to the first vertex for precision."""
    n = F.size(ring)
    head = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = F.zip_with(
        head, tail,
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def st_area(g) -> Column:
    """Planar area: shells minus holes, summed over the parts; lines and points, closed or not, have none."""
    g = _c(g)

    def part_area(part: Column) -> Column:
        areas = F.transform(part, _ring_area)
        total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)
        return F.when(F.size(part) > 0, 2 * areas[0] - total).otherwise(F.lit(0.0))

    flat = g["kind"].isin(*FLAT_KINDS) & g["parts"].isNotNull()
    return F.when(flat, F.lit(0.0)).otherwise(F.aggregate(F.transform(g["parts"], part_area), F.lit(0.0), lambda s, a: s + a))


def map_points(g, fn) -> Column:
    g = _c(g)
    parts = F.transform(
        g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, fn))
    )
    return F.when(g.isNotNull(), geometry(g["kind"], parts, g["srid"]))


def st_force2d(g) -> Column:
    return map_points(g, lambda p: make_point(p["x"], p["y"], 0.0))


def st_translate(g, dx, dy, dz=0.0) -> Column:
    dx, dy, dz = _num(dx), _num(dy), _num(dz)
    return map_points(g, lambda p: make_point(p["x"] + dx, p["y"] + dy, p["z"] + dz))


def st_affine(g, m: list[Column]) -> Column:
    """Twelve parameters: nine of the 3x3 matrix row by row, then three offsets."""
    a, b, c, d, e, f, k, h, i, ox, oy, oz = [_num(v) for v in m]
    return map_points(
        g,
        lambda p: make_point(
            a * p["x"] + b * p["y"] + c * p["z"] + ox,
            d * p["x"] + e * p["y"] + f * p["z"] + oy,
            k * p["x"] + h * p["y"] + i * p["z"] + oz,
        ),
    )


FLAT_KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "CircularString", "CompoundCurve", "MultiCurve")
POLYGON_KINDS = ("Polygon", "MultiPolygon", "PolyhedralSurface", "Triangle", "Tin")


def polygons_only(g) -> Column:
    """Polygon parts of a geometry: rings of at least four closed vertices; none of lines and points."""
    g = _c(g)
    kept = F.filter(
        g["parts"],
        lambda part: (F.size(part) > 0) & (F.size(part[0]) >= 4)
        & (part[0][0]["x"] == F.element_at(part[0], -1)["x"])
        & (part[0][0]["y"] == F.element_at(part[0], -1)["y"]),
    )
    kept = F.when(g["kind"].isin(*FLAT_KINDS), F.slice(kept, 1, 0)).otherwise(kept)
    return F.when(g.isNotNull(), geometry("MultiPolygon", kept, g["srid"]))


def st_multi(g) -> Column:
    g = _c(g)
    kind = F.when(g["kind"].startswith("Multi"), g["kind"]).otherwise(
        F.concat(F.lit("Multi"), g["kind"])
    )
    return F.when(g.isNotNull(), geometry(kind, g["parts"], g["srid"]))


def st_forcecollection(g) -> Column:
    """Polyhedral surface to a collection of polygons, others unchanged."""
    g = _c(g)
    return F.when(
        g["kind"] == "PolyhedralSurface",
        geometry("GeometryCollection", g["parts"], g["srid"]),
    ).otherwise(g)


def st_collect_pair(a, b) -> Column:
    """Collect of two geometries; a null side is skipped."""
    a, b = _c(a), _c(b)
    both = geometry("GeometryCollection", F.concat(a["parts"], b["parts"]), a["srid"])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def collect_parts(g) -> Column:
    """Aggregate: all parts of a group as one geometry (bounded groups only)."""
    g = _c(g)
    return geometry("GeometryCollection", F.flatten(F.collect_list(g["parts"])), F.min(g["srid"]))


def slanted_envelope(b: Column, srid=3879) -> Column:
    """Five-point 3D envelope: two corners at the lowest, two at the highest z."""
    ring = F.array(
        make_point(b["xmin"], b["ymin"], b["zmin"]), make_point(b["xmax"], b["ymin"], b["zmin"]),
        make_point(b["xmax"], b["ymax"], b["zmax"]), make_point(b["xmin"], b["ymax"], b["zmax"]),
        make_point(b["xmin"], b["ymin"], b["zmin"]),
    )
    return F.when(b.isNotNull(), st_makepolygon(ring, srid))


def extent_agg(b: Column) -> Column:
    """Aggregate: union of bbox structs."""
    return F.struct(
        *[F.min(b[f"{a}min"]).alias(f"{a}min") for a in "xyz"],
        *[F.max(b[f"{a}max"]).alias(f"{a}max") for a in "xyz"],
    ).cast(BBOX_DDL)


def contains_point(g, x, y) -> Column:
    """True if the point lies inside or on the boundary of any polygon part."""
    g = _c(g)
    x, y = _num(x), _num(y)

    def edges(ring: Column):
        n = F.size(ring)
        return F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(
            ring, F.lit(2), F.greatest(n - 1, F.lit(0))
        )

    def crossings(ring: Column) -> Column:
        head, tail = edges(ring)
        hit = F.zip_with(
            head, tail,
            lambda p, q: F.when(
                (p["y"] > y) != (q["y"] > y),
                (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]).cast("int"),
            ).otherwise(0),
        )
        return F.aggregate(hit, F.lit(0), lambda s, v: s + v)

    def touches(ring: Column) -> Column:
        head, tail = edges(ring)
        on = F.zip_with(
            head, tail,
            lambda p, q: ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"]))
            & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
            & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])),
        )
        return F.exists(on, lambda v: v)

    def inside(part: Column) -> Column:
        total = F.aggregate(F.transform(part, crossings), F.lit(0), lambda s, v: s + v)
        return (total % 2 == 1) | F.exists(part, touches)

    return F.exists(g["parts"], inside)


def covers_box(g, x0, y0, x1, y1) -> Column:
    """True if the polygon parts cover the whole box: a corner lies inside one part and no edge of any part enters the box."""
    g = _c(g)
    x0, y0, x1, y1 = (_num(v) for v in (x0, y0, x1, y1))

    def enters(p: Column, q: Column) -> Column:
        apart = (F.greatest(p["x"], q["x"]) < x0) | (F.least(p["x"], q["x"]) > x1) | (F.greatest(p["y"], q["y"]) < y0) | (F.least(p["y"], q["y"]) > y1)

        def side(x, y):  # of the line through the edge
            return F.signum((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))

        corners = side(x0, y0) + side(x1, y0) + side(x1, y1) + side(x0, y1)
        return ~apart & (F.abs(corners) < 4)

    def entered(ring: Column) -> Column:
        n = F.size(ring)
        head, tail = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
        return F.exists(F.zip_with(head, tail, enters), lambda v: v)

    whole = F.exists(g["parts"], lambda part: F.exists(part, entered))
    return F.coalesce(g["kind"].isin(*POLYGON_KINDS, "GeometryCollection") & ~whole & contains_point(g, x0, y0), F.lit(False))
