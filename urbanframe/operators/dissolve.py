"""Union of the geometries of a group, with bounded work per task.

``covered_area`` is a sweep with edges as rows. A group starts as one cell, its
extent; a cell that many pieces reach is cut into 4 x 4 smaller ones, pieces that
cover a cell settle it at once, and the others go on. In a cell the edges are cut
at every end and crossing, windows over the edges of each strip count how many
pieces lie over a place, and the covered heights times the widths add up. A group
of any size spreads over the cells it fills.

``dissolve`` merges in two steps, chunks of a group first, so that a hot group is
collected as the unions of its chunks only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.session import any_size, cut_lineage

#: Chunks of a group in the first step of a dissolve; pieces of a cell before it is cut; smallest cell as a part of the extent.
CHUNKS, CROWD, FINEST = 256, 32, 4.0**-13


def dissolve(df: DataFrame, keys: list[str], geom: str, row_id: str, chunks: int = CHUNKS) -> DataFrame:
    """One dissolved geometry per key: (keys, geom).

    ``row_id`` spreads the pieces of a group over its chunks.
    """
    rows = df.select(*keys, F.col(geom).alias("_g"), F.pmod(F.xxhash64(row_id), F.lit(chunks)).alias("_chunk"))
    parts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), G.collect_parts("_g").alias("_g"))
    # a single piece waits for the second step
    merged = F.when(F.col("_n") > 1, K.st_unaryunion(F.when(F.col("_n") > 1, F.col("_g")))).otherwise(F.col("_g"))
    return (
        parts.withColumn("_g", merged).groupBy(*keys).agg(G.collect_parts("_g").alias("_g"))
        .select(*keys, K.st_unaryunion("_g").alias(geom))
    )


_CELL = ("cx0", "cy0", "cx1", "cy1")
_PLACE = ["_k", *_CELL]


def _part_box(part: Column) -> list[Column]:
    pts = F.flatten(part)
    ends = {"x": F.transform(pts, lambda p: p["x"]), "y": F.transform(pts, lambda p: p["y"])}
    return [fn(ends[a]).alias(f"{c}") for c, fn, a in (("px0", F.array_min, "x"), ("py0", F.array_min, "y"), ("px1", F.array_max, "x"), ("py1", F.array_max, "y"))]


def _pieces(df: DataFrame, keys: list[str], geom: str) -> DataFrame:
    """Distinct parts of each group with their boxes and the cell they start in, the extent of the group."""
    parts = df.select(F.struct(*keys).alias("_k"), F.explode(f"{geom}.parts").alias("part")).distinct()
    parts = parts.select("_k", "part", *_part_box(F.col("part")), F.col("part").isNotNull().alias("_ok")).where("px0 < px1 AND py0 < py1").drop("_ok")
    parts = cut_lineage(parts.withColumn("pid", F.monotonically_increasing_id()))
    extent = parts.groupBy("_k").agg(
        F.min("px0").alias("cx0"), F.min("py0").alias("cy0"), F.max("px1").alias("cx1"), F.max("py1").alias("cy1"),
    ).withColumn("limit", F.greatest(F.expr("cx1 - cx0"), F.expr("cy1 - cy0")) * FINEST)
    return parts.join(any_size(extent), "_k")


def _cut_cells(rows: DataFrame) -> DataFrame:
    """The pieces in the sixteen parts of their cells that their boxes enter."""
    for a in "xy":
        # the outer lines stay as they are, so that neighbours share theirs
        lines = F.expr(f"array(c{a}0, c{a}0 + (c{a}1 - c{a}0) / 4, c{a}0 + (c{a}1 - c{a}0) / 2, c{a}0 + (c{a}1 - c{a}0) * 3 / 4, c{a}1)")
        rows = rows.withColumn("_lines", lines).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3))))
        rows = rows.withColumns({f"c{a}0": F.col("_lines")[F.col("_i")], f"c{a}1": F.col("_lines")[F.col("_i") + 1]}).drop("_lines", "_i")
        rows = rows.where(f"p{a}0 < c{a}1 AND p{a}1 > c{a}0")
    return rows


def _settled(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Cells that a piece covers: (_k, area); and the pieces of all other cells, none of them crowded."""
    covered, open_rows = [], []
    # Nothing is cut where no cell is crowded: one count, and its table if any is.
    while True:
        sizes = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_n"), F.first("limit").alias("limit"))
        crowded = sizes.where((F.col("_n") > crowd) & (F.expr("greatest(cx1 - cx0, cy1 - cy0)") > F.col("limit"))).select(*_PLACE)
        crowded = cut_lineage(crowded)
        if crowded.isEmpty():
            open_rows.append(rows)
            break
        open_rows.append(rows.join(crowded, _PLACE, "left_anti"))
        cut = _cut_cells(rows.join(crowded, _PLACE, "left_semi"))
        box = [F.col(c) for c in _CELL]
        geom = G.geometry("Polygon", F.array("part"), 0)
        # inside, outside or on the border of the piece
        covers = G.covers_box(geom, *box)
        cut = cut_lineage(cut.withColumn("_covers", covers))
        full = cut.where("_covers").select(*_PLACE).distinct()
        covered.append(full.select("_k", F.expr("(cx1 - cx0) * (cy1 - cy0)").alias("area")))
        rows = cut.where("NOT _covers").drop("_covers").join(full, _PLACE, "left_anti")
        rows = cut_lineage(rows.where(_touches(F.col("part"), *box)))
    columns = ["_k", "pid", "part", *_CELL]
    union = lambda frames: reduce(DataFrame.union, frames)
    rest = union([r.select(*columns) for r in open_rows])
    return (union(covered) if covered else rest.select("_k", F.lit(0.0).alias("area")).limit(0)), rest


def _touches(part: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does an edge of the part meet the open box? Of pieces that cover no cell the others lie outside."""

    def edge(p: Column, q: Column) -> Column:
        apart = (F.greatest(p["x"], q["x"]) <= x0) | (F.least(p["x"], q["x"]) >= x1) | (F.greatest(p["y"], q["y"]) <= y0) | (F.least(p["y"], q["y"]) >= y1)
        side = lambda x, y: F.signum((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))
        return ~apart & (F.abs(side(x0, y0) + side(x1, y0) + side(x1, y1) + side(x0, y1)) < 4)

    def ring(r: Column) -> Column:
        n = F.size(r)
        head, tail = F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(n - 1, F.lit(0)))
        return F.exists(F.zip_with(head, tail, edge), lambda v: v)

    # an edge along the border of the box may leave the inside covered
    centre = G.contains_point(G.geometry("Polygon", F.array(part), 0), (x0 + x1) / 2, (y0 + y1) / 2)
    return F.exists(part, ring) | centre


def _edges(rows: DataFrame) -> DataFrame:
    """Non-vertical edges of the pieces of a cell, left to right, cut at its left and right side."""
    pairs = F.flatten(F.transform("part", lambda r: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))),
        lambda i: F.struct(F.get(r, i)["x"].alias("xa"), F.get(r, i)["y"].alias("ya"), F.get(r, i + 1)["x"].alias("xb"), F.get(r, i + 1)["y"].alias("yb")),
    )))
    e = rows.select(*_PLACE, "pid", F.posexplode(pairs).alias("eid", "e")).select(*_PLACE, "pid", "eid", "e.*").where("xa != xb")
    flip = F.col("xa") > F.col("xb")
    e = e.withColumns({
        "x1": F.least("xa", "xb"), "x2": F.greatest("xa", "xb"),
        "y1": F.when(flip, F.col("yb")).otherwise(F.col("ya")), "y2": F.when(flip, F.col("ya")).otherwise(F.col("yb")),
    }).where("x1 < cx1 AND x2 > cx0")
    # the line stays as it is; only the reach of the edge is cut
    return e.withColumns({"s": F.expr("(y2 - y1) / (x2 - x1)"), "l": F.greatest("x1", "cx0"), "r": F.least("x2", "cx1")}).select(
        *_PLACE, "pid", "eid", F.col("x1").alias("x"), F.col("y1").alias("y"), "s", "l", "r"
    )


def _strips(edges: DataFrame) -> DataFrame:
    """(cell, s0, s1): strips between neighbouring cuts: ends of edges, crossings, and where a line leaves the cell."""
    ends = edges.select(*_PLACE, F.explode(F.array("l", "r")).alias("cut"))
    sloped = edges.where("s != 0")
    borders = sloped.select(*_PLACE, "l", "r", F.explode(F.expr("array(x + (cy0 - y) / s, x + (cy1 - y) / s)")).alias("cut"))
    a = sloped.select(*_PLACE, *[F.col(c).alias(f"a_{c}") for c in ("pid", "eid", "x", "y", "s", "l", "r")])
    b = edges.select(*_PLACE, *[F.col(c).alias(f"b_{c}") for c in ("pid", "eid", "x", "y", "s", "l", "r")])
    both = a.join(any_size(b), _PLACE).where("a_l < b_r AND b_l < a_r AND a_s != b_s AND (b_s = 0 OR a_pid < b_pid OR (a_pid = b_pid AND a_eid < b_eid))")
    both = both.select(
        *_PLACE, F.expr("greatest(a_l, b_l)").alias("l"), F.expr("least(a_r, b_r)").alias("r"),
        F.expr("a_x + ((b_y - a_y) + b_s * (a_x - b_x)) / (a_s - b_s)").alias("cut"),
    )
    inner = borders.union(both).where("cut > l AND cut < r").select(*_PLACE, "cut")
    cuts = ends.union(inner).distinct()
    own = Window.partitionBy(*_PLACE).orderBy("cut")
    return cuts.select(*_PLACE, F.col("cut").alias("s0"), F.lead("cut").over(own).alias("s1")).where("s1 IS NOT NULL")


def _swept(rows: DataFrame) -> DataFrame:
    """(_k, area) of each cell: in a strip no two lines cross, so heights at its middle are exact."""
    edges = cut_lineage(_edges(rows))
    met = edges.join(any_size(_strips(edges)), _PLACE).where("l <= s0 AND r >= s1")
    met = met.withColumn("h", F.expr("y + s * ((s0 + s1) / 2 - x)"))
    strip = [*_PLACE, "s0"]
    odd = F.row_number().over(Window.partitionBy(*strip, "pid").orderBy("h", "eid")) % 2
    met = met.withColumn("d", F.when(odd == 1, 1).otherwise(-1)).withColumn("h", F.expr("greatest(cy0, least(cy1, h))"))
    up = Window.partitionBy(*strip).orderBy("h", F.desc("d"))
    over = F.sum("d").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = met.select("_k", F.expr("s1 - s0").alias("w"), over.alias("over"), (F.lead("h").over(up) - F.col("h")).alias("high"))
    return met.where("over > 0 AND high > 0").select("_k", F.expr("w * high").alias("area"))


def covered_area(df: DataFrame, keys: list[str], geom: str, crowd: int = CROWD) -> DataFrame:
    """Area of the union per key, overlaps counted once: (keys, covered_area); 0 for groups without area.

    A part is even-odd inside itself. Pieces that all meet in one point keep that
    point's cell crowded down to the finest cells, which are then swept as they are.
    """
    groups = df.select(*keys).distinct()
    full, rest = _settled(_pieces(df, keys, geom), crowd)
    areas = full.union(_swept(rest)).groupBy("_k").agg(F.sum("area").alias("covered_area")).select(
        *[F.col(f"_k.{k}").alias(f"_k_{k}") for k in keys], "covered_area"
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return groups.join(areas, same, "left").select(*keys, F.coalesce("covered_area", F.lit(0.0)).alias("covered_area"))
