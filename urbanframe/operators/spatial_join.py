"""Spatial joins as grid-keyed equi joins.

A distance or overlap predicate has no equi key, so Spark would compare every
pair. Here each bounding box is written once per grid cell it touches and the
join runs on the cell. Cells come in levels whose sizes grow by eight; a box
enters the finest level where it is at most two cells wide. Levels go as high as
the largest box asks for.

Boxes of one level meet in their cells. A larger box walks down to the levels of
smaller boxes through the cells these occupy: a cell of the covering is joined
with the occupied cells one level below it, so no small box is ever written to a
coarse cell, and a very large box yields as many cells as it has neighbours. Two
boxes meet on the finer of their two levels, in the cell that holds the lower-left
corner of their overlap, so each pair appears exactly once and no ``distinct`` is
needed. Because cells follow the size of the boxes, boxes that do not overlap can
share a cell with a bounded number of their kind only.

On the way down a cell that a polygon covers with room to spare is an inner cell:
all it holds lies in the polygon, and no exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.operators import box_tree
from urbanframe.session import any_size, cut_lineage, side_by_side

RATIO = 8
MAX_SPAN = 2
CELL = 0.5

_EDGES = (("x0", "xmin"), ("x1", "xmax"), ("y0", "ymin"), ("y1", "ymax"))


def _native_level(box: str) -> str:
    """Finest level at which the box is at most ``MAX_SPAN`` cells wide, as SQL text."""
    side = f"greatest({box}.xmax - {box}.xmin, {box}.ymax - {box}.ymin)"
    return f"int(greatest(0D, ceil(ln(greatest({side}, {CELL}D) / {MAX_SPAN * CELL}D) / ln({RATIO}D) - 1e-9D)))"


def _present(df: DataFrame, box: str) -> list[int]:
    """Levels of a layer's boxes, a handful of numbers."""
    rows = df.where(F.col(box).isNotNull()).select(F.expr(_native_level(box)).alias("l")).distinct().collect()
    return sorted(r.l for r in rows)


def _size(level: str | int) -> str:
    return f"({CELL}D * power({RATIO}D, {level}))"


def _edged(df: DataFrame, box: str, tag: str) -> DataFrame:
    """Rows with a box, its edges as plain columns and its level; ``_t_inner``: inside a covering polygon."""
    df = df.where(F.col(box).isNotNull())
    df = df.withColumns({f"_{tag}_{c}": F.col(f"{box}.{f}") for c, f in _EDGES})
    return df.withColumns({f"_{tag}_native": F.expr(_native_level(box)), f"_{tag}_inner": F.lit(False)})


def _span(tag: str, axis: str, level: str | int) -> tuple[Column, Column]:
    """First and last cell of the box on one axis."""
    size = _size(level)
    return F.expr(f"floor(_{tag}_{axis}0 / {size})"), F.expr(f"floor(_{tag}_{axis}1 / {size})")


def _own_cells(df: DataFrame, tag: str) -> DataFrame:
    """One row per cell a box touches on its own level."""
    df = df.withColumn(f"_{tag}_l", F.col(f"_{tag}_native"))
    for axis in "xy":
        df = df.withColumn(f"_{tag}_c{axis}", F.explode(F.sequence(*_span(tag, axis, f"_{tag}_native"))))
    return df


def _occupied(own: DataFrame, tag: str, levels: list[int], top: int) -> dict[int, DataFrame]:
    """Cells (_cx, _cy) of each level up to ``top`` that hold boxes of that level or of a finer one."""
    out: dict[int, DataFrame] = {}
    for level in range(levels[0], top + 1):
        cells = None
        if level in levels:
            cells = own.where(F.col(f"_{tag}_l") == level).select(F.col(f"_{tag}_cx").alias("_cx"), F.col(f"_{tag}_cy").alias("_cy"))
        if level - 1 in out:
            below = out[level - 1].select(F.expr(f"floor(_cx / {RATIO}D)").alias("_cx"), F.expr(f"floor(_cy / {RATIO}D)").alias("_cy"))
            cells = below if cells is None else cells.union(below)
        out[level] = cells.distinct()
    return out


def _walk_down(own: DataFrame, tag: str, levels: list[int], other: dict[int, DataFrame], other_levels: list[int], geom: str | None) -> list[DataFrame]:
    """Cells of larger boxes on the finer levels of the other side, one frame a level."""
    out, above = [], None
    for level in range(levels[-1], other_levels[0], -1):
        here = own.where(F.col(f"_{tag}_l") == level) if level in levels else None
        here = above if here is None else here if above is None else here.union(above)
        if here is None or level - 1 not in other:
            continue
        if geom is not None:
            here = here.withColumn(f"_{tag}_inner", F.col(f"_{tag}_inner") | _covered(geom, tag, level))
        cells = other[level - 1].withColumns({"_px": F.expr(f"floor(_cx / {RATIO}D)"), "_py": F.expr(f"floor(_cy / {RATIO}D)")})
        met = here.join(any_size(cells), (F.col(f"_{tag}_cx") == F.col("_px")) & (F.col(f"_{tag}_cy") == F.col("_py")))
        for axis in "xy":
            met = met.where(F.col(f"_c{axis}").between(*_span(tag, axis, level - 1)))
        above = met.withColumns({f"_{tag}_l": F.lit(level - 1), f"_{tag}_cx": F.col("_cx"), f"_{tag}_cy": F.col("_cy")}).select(own.columns)
        if level - 1 in other_levels:
            out.append(above)
    return out


def _covered(geom: str, tag: str, level: int) -> Column:
    """Does the polygon cover the cell and a quarter more on its upper sides, as far as boxes of finer levels reach?"""
    size = _size(level)
    x, y = F.expr(f"_{tag}_cx * {size}"), F.expr(f"_{tag}_cy * {size}")
    reach = F.expr(f"{size} * {1 + MAX_SPAN / RATIO}D")
    # a cell that leaves the box is not covered, whatever the polygon looks like
    fits = (x >= F.col(f"_{tag}_x0")) & (y >= F.col(f"_{tag}_y0")) & (x + reach <= F.col(f"_{tag}_x1")) & (y + reach <= F.col(f"_{tag}_y1"))
    return F.when(fits, G.covers_box(geom, x, y, x + reach, y + reach)).otherwise(False)


def bbox_join(
    left: DataFrame, right: DataFrame, left_box: str, right_box: str, left_geom: str | None = None, right_geom: str | None = None
) -> DataFrame:
    """All pairs whose 2D bounding boxes overlap or touch, each exactly once.

    Column names of the two sides must be disjoint; null boxes never match. With
    the names of polygon columns, ``_inner`` tells pairs whose smaller box lies in
    an inner cell of the larger polygon.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"rename these columns on one side first: {sorted(clash)}")
    a, b = _own_cells(_edged(left, left_box, "a"), "a"), _own_cells(_edged(right, right_box, "b"), "b")
    present = _present(left, left_box), _present(right, right_box)
    if all(present):
        top = max(present[0][-1], present[1][-1]) - 1
        more_a = _walk_down(a, "a", present[0], _occupied(b, "b", present[1], top), present[1], left_geom)
        more_b = _walk_down(b, "b", present[1], _occupied(a, "a", present[0], top), present[0], right_geom)
        for more in more_a:
            a = a.union(more)
        for more in more_b:
            b = b.union(more)
    size = _size("_a_l")
    on = F.expr(
        "_a_l = _b_l AND _a_cx = _b_cx AND _a_cy = _b_cy AND _a_l = least(_a_native, _b_native) "
        "AND _a_x0 <= _b_x1 AND _a_x1 >= _b_x0 AND _a_y0 <= _b_y1 AND _a_y1 >= _b_y0 "
        f"AND floor(greatest(_a_x0, _b_x0) / {size}) = _a_cx AND floor(greatest(_a_y0, _b_y0) / {size}) = _a_cy"
    )
    helper = [f"_{t}_{n}" for t in "ab" for n in ("l", "cx", "cy", "native", "inner", "x0", "x1", "y0", "y1")]
    pairs = a.join(any_size(b), on, "inner")
    if left_geom or right_geom:
        pairs = pairs.withColumn("_inner", F.expr("_a_inner OR _b_inner"))
    return pairs.drop(*helper)


def join_intersects(
    left: DataFrame, right: DataFrame, left_geom: str, right_geom: str,
    left_box: str, right_box: str,
) -> DataFrame:
    """Pairs whose geometries share at least one point; inner cells answer without an exact test."""
    pairs = bbox_join(left, right, left_box, right_box, left_geom, right_geom)
    tested = K.st_intersects(F.when(~F.col("_inner"), F.col(left_geom)), right_geom)
    return pairs.where(F.col("_inner") | tested).drop("_inner")


def join_dwithin(
    left: DataFrame, right: DataFrame, left_geom: str, right_geom: str,
    left_box: str, right_box: str, radius: float,
) -> DataFrame:
    """Pairs at most ``radius`` apart, with their exact ``distance_m``."""
    grown = left.withColumn("_grown", G.bbox_expand(F.col(left_box), radius))
    pairs = bbox_join(grown, right, "_grown", right_box)
    near = G.bbox_distance(F.col(left_box), F.col(right_box)) <= radius
    return (
        pairs.where(near)
        .withColumn("distance_m", K.st_distance(left_geom, right_geom))
        .where(F.col("distance_m") <= radius)
        .drop("_grown")
    )


def pairs_within(df: DataFrame, key: str, geom: str, box: str, radius: float) -> DataFrame:
    """Self join: unordered pairs of rows with different keys (``a_`` key smaller)."""
    df = cut_lineage(df)
    a = df.select([F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select([F.col(c).alias(f"b_{c}") for c in df.columns])
    grown = a.withColumn("_grown", G.bbox_expand(F.col(f"a_{box}"), radius))
    pairs = bbox_join(grown, b, "_grown", f"b_{box}").drop("_grown")
    ordered = F.col(f"b_{key}") > F.col(f"a_{key}")
    near = G.bbox_distance(F.col(f"a_{box}"), F.col(f"b_{box}")) <= radius
    return (
        pairs.where(ordered & near)
        .withColumn("distance_m", K.st_distance(f"a_{geom}", f"b_{geom}"))
        .where(F.col("distance_m") <= radius)
    )


def semi_dwithin_points(
    df: DataFrame, key: str, geom: str, box: str, points: DataFrame, x: str, y: str, radius: float
) -> DataFrame:
    """Rows of ``df`` with at least one point within ``radius`` (EXISTS).

    Points are first reduced to occupied cells with one representative each.
    Most rows are decided by a representative; only the rest look at single
    points, and only in cells the radius can still reach.
    """
    size = max(radius / 4, 1.0)
    pts = points.select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    pts = pts.withColumns({"_pcx": F.floor(F.col("_px") / size), "_pcy": F.floor(F.col("_py") / size)})
    cells = pts.groupBy("_pcx", "_pcy").agg(
        F.min("_px").alias("x0"), F.max("_px").alias("x1"),
        F.min("_py").alias("y0"), F.max("_py").alias("y1"),
        F.min(F.struct("_px", "_py")).alias("_rep"),
    ).select(
        F.col("_pcx"), F.col("_pcy"), F.col("_rep"),
        G.bbox_struct(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("_cbox"),
    )
    rows = df.select(F.col(key).alias("_key"), F.col(geom).alias("_geom"), F.col(box).alias("_box"))
    grown = rows.withColumn("_grown", G.bbox_expand(F.col("_box"), radius))
    cand = bbox_join(grown, cells, "_grown", "_cbox")
    cand = cand.where(G.bbox_distance(F.col("_box"), F.col("_cbox")) <= radius)
    rep = G.st_point(F.col("_rep._px"), F.col("_rep._py"), srid=F.col("_geom.srid"))
    cand = cut_lineage(
        cand.select("_key", "_pcx", "_pcy", "_cbox", (K.st_distance(F.col("_geom"), rep) <= radius).alias("_hit"))
    )
    sure = cand.where("_hit").select("_key").distinct()
    corner = G.st_rectangle(
        F.col("_cbox.xmin"), F.col("_cbox.ymin"), F.col("_cbox.xmax"), F.col("_cbox.ymax"),
        srid=F.col("_geom.srid"),
    )
    # A cell of one point decides by itself; other misses need their points.
    several = (F.col("_cbox.xmin") < F.col("_cbox.xmax")) | (F.col("_cbox.ymin") < F.col("_cbox.ymax"))
    open_cells = (
        cand.where(~F.col("_hit") & several)
        .join(sure, "_key", "left_anti")
        .join(any_size(rows), "_key")
        .where(K.st_distance(F.col("_geom"), corner) <= radius)
        .select("_key", "_geom", "_box", "_pcx", "_pcy")
    )
    dot = G.bbox_struct(F.col("_px"), F.col("_py"), F.col("_px"), F.col("_py"))
    late = (
        open_cells.join(pts.distinct(), ["_pcx", "_pcy"])
        .where(G.bbox_distance(F.col("_box"), dot) <= radius)
        .where(K.st_distance(F.col("_geom"), G.st_point(F.col("_px"), F.col("_py"), srid=F.col("_geom.srid"))) <= radius)
        .select("_key").distinct()
    )
    keep = sure.union(late)
    return df.join(keep.withColumnRenamed("_key", key), key, "left_semi")


def nearest_candidates(left: DataFrame, right: DataFrame, other_only: bool = False) -> DataFrame:
    """Pairs (lk, rk) among which each left row's nearest right row is, from (id, x0, y0, x1, y1, ax, ay) on both sides.

    Two cell pyramids are walked down together; what remains of a cell is carried
    on with the best bound so far. In the leaves every row gets its own bound from
    the anchors and box sides it meets, and only boxes that near stay.
    """
    frame = box_tree.frame_of(left, right)
    if frame is None:
        return left.join(right.select(F.col("id").alias("rk")), F.col("id") == F.col("rk")).select(F.col("id").alias("lk"), "rk")
    trees = side_by_side(lambda: box_tree.pyramid(left, frame), lambda: box_tree.pyramid(right, frame))
    pairs = box_tree.descend(*trees, other_only)
    rows = [t.rows.select([F.col(c).alias(f"{side}_{c}") for c in t.rows.columns]) for t, side in zip(trees, "ab")]
    gap = box_tree.gap2(box_tree.box("a"), box_tree.box("b"))
    anchors = F.pow(F.col("a_ax") - F.col("b_ax"), 2) + F.pow(F.col("a_ay") - F.col("b_ay"), 2)
    apart = F.least(anchors, box_tree.facing2(box_tree.box("a"), box_tree.box("b")))

    def met(own: DataFrame) -> DataFrame:
        both = pairs.join(any_size(own), F.col("a") == F.col("a_cell")).join(any_size(rows[1]), F.col("b") == F.col("b_cell"))
        both = both.withColumn("gap", gap).where(box_tree.within(F.col("gap"), F.col("bound")))
        return both.where(F.col("a_id") != F.col("b_id")) if other_only else both

    # The pairs of two leaves are many: they are met twice, so that no shuffle carries them.
    best = met(rows[0]).select("a_id", apart.alias("apart")).groupBy("a_id").agg(F.min("apart").alias("own_bound"))
    own = cut_lineage(rows[0].join(any_size(best), "a_id"))
    return met(own).where(box_tree.within(F.col("gap"), F.col("own_bound"))).select(F.col("a_id").alias("lk"), F.col("b_id").alias("rk"))


def nearest(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    left_geom: str, right_geom: str, left_box: str, right_box: str, other_only: bool = False,
) -> DataFrame:
    """Nearest right row per left row: (left_key, right_key, distance_m).

    Cell pyramids leave a few candidates per row (``nearest_candidates``), which get
    exact distances. Ties go to the smallest right key. ``other_only`` skips rows
    with equal keys (nearest other row of the same layer).
    """
    # Copies of one geometry answer alike: the smallest key speaks for them (two, if
    # a row must not meet itself), so a stack of copies cannot blow up the candidates.
    # The hash comes first so that sorting rarely compares whole geometries.
    copies = Window.partitionBy("_hash", "_geom").orderBy("_key")
    right = (
        right.select(F.col(right_key).alias("_key"), F.col(right_geom).alias("_geom"), F.col(right_box).alias("_box"))
        .withColumn("_hash", F.xxhash64("_geom"))
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= (2 if other_only else 1))
        .drop("_copy", "_hash")
    )
    left = left.select(F.col(left_key).alias("_key"), F.col(left_geom).alias("_geom"), F.col(left_box).alias("_box"))
    written = [s.withColumn("_v", G.first_vertex("_geom")).where("_v IS NOT NULL") for s in (left, right)]
    sides = side_by_side(*[lambda s=s: cut_lineage(s) for s in written])
    flat = [
        s.select(F.col("_key").alias("id"), *[F.col(f"_box.{f}").alias(c) for c, f in _EDGES], F.col("_v.x").alias("ax"), F.col("_v.y").alias("ay"))
        for s in sides
    ]
    pairs = nearest_candidates(*flat, other_only)
    l = sides[0].select(F.col("_key").alias("lk"), F.col("_geom").alias("_lg"))
    r = sides[1].select(F.col("_key").alias("rk"), F.col("_geom").alias("_rg"))
    out_right = f"nearest_{right_key}" if right_key == left_key else right_key
    return (
        pairs.join(any_size(l), "lk").join(any_size(r), "rk")
        .withColumn("_d", K.st_distance("_lg", "_rg"))
        .groupBy(F.col("lk").alias(left_key))
        .agg(F.min(F.struct("_d", "rk")).alias("_m"))
        .select(left_key, F.col("_m.rk").alias(out_right), F.col("_m._d").alias("distance_m"))
    )
