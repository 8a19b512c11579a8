"""Cell pyramids over rows with boxes, and the pairs of their cells that can hold partners.

A pyramid divides the square around all anchor points into 8 x 8 cells, and each
cell with more than ``LEAF`` rows again, so its height follows the extent of the
data and how crowded its places are: a spot with a third of all rows only gets
more levels. A row lies in one leaf, by its anchor; a cell carries the box of
everything below it. Levels are tables, built from the rows still in crowded
cells.

``descend`` walks two pyramids level by level and keeps, for each cell of the
left one, the cells of the right one that may still hold a nearest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.session import any_size, cut_lineage

LEAF = 32
BITS = 3  # bits of each axis that a level adds
LEVELS = 10
_BOX = ("x0", "y0", "x1", "y1")


def _key(level: int) -> Column:
    """Level and both cell numbers in one long."""
    drop = BITS * (LEVELS - level)
    cell = F.shiftleft(F.shiftright("ix", drop), BITS * LEVELS).bitwiseOR(F.shiftright("iy", drop))
    return F.shiftleft(F.lit(level).cast("long"), 2 * BITS * LEVELS).bitwiseOR(cell)


class Pyramid:
    """Cells of all levels, and the rows (id, box, anchor) with their leaf ``cell``."""

    def __init__(self, levels: list[DataFrame], rows: DataFrame):
        self.levels, self.rows = levels, rows

    def children(self, side: str) -> DataFrame:
        """Every cell under its parent; a leaf is also its own child, to wait for the other side."""
        cells = self.levels[0]
        for more in self.levels[1:]:
            cells = cells.union(more)
        cells = cells.select(F.explode(F.when(F.col("leaf"), F.array("parent", "cell")).otherwise(F.array("parent"))).alias(f"{side}_parent"), "*")
        return cells.select(f"{side}_parent", *[F.col(c).alias(f"{side}_{c}") for c in self.levels[0].columns if c not in ("parent", "leaf", "n")])


def frame_of(*sides: DataFrame) -> tuple[float, float, float] | None:
    """Lower left corner and side of the square around the anchors of all sides (four numbers to the driver)."""
    both = sides[0].select("ax", "ay")
    for s in sides[1:]:
        both = both.union(s.select("ax", "ay"))
    x0, y0, x1, y1 = both.agg(F.min("ax"), F.min("ay"), F.max("ax"), F.max("ay")).first()
    if x0 is None:
        return None
    return x0, y0, max(x1 - x0, y1 - y0) or 1.0


def pyramid(rows: DataFrame, frame: tuple[float, float, float], leaf: int = LEAF) -> Pyramid:
    """Pyramid of ``rows`` (id, x0, y0, x1, y1, ax, ay), a written table.

    Each level groups the rows of the crowded cells above it; a row finds its leaf
    by its cell number at that level.
    """
    ox, oy, size = frame
    at = lambda c, o: F.floor((F.col(c) - o) / size * ((1 << BITS * LEVELS) - 1)).cast("long")
    placed = rows.withColumns({"ix": at("ax", ox), "iy": at("ay", oy)})
    rest, levels, done = placed, [], []
    for level in range(1, LEVELS + 1):
        parent = F.min(_key(level - 1)) if level > 1 else F.lit(0).cast("long")
        anchor = F.struct("id", "ax", "ay")
        cells = rest.groupBy(_key(level).alias("cell")).agg(
            parent.alias("parent"), F.count(F.lit(1)).alias("n"),
            *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
            F.min("ax").alias("ax0"), F.min("ay").alias("ay0"), F.max("ax").alias("ax1"), F.max("ay").alias("ay1"),
            F.min(anchor).alias("lo"), F.max(anchor).alias("hi"),
        )
        full = F.lit(False) if level == LEVELS else F.col("n") > leaf
        cells = cut_lineage(cells.withColumn("leaf", ~full))
        levels.append(cells)
        keyed = placed.withColumn("cell", _key(level))
        done.append(keyed.join(any_size(cells.where("leaf").select("cell")), "cell", "left_semi"))
        crowded = cells.where("NOT leaf").select("cell")
        if crowded.isEmpty():
            break
        rest = keyed.join(crowded, "cell", "left_semi").drop("cell")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return Pyramid(levels, out.select(*rows.columns, "cell"))


def gap2(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Squared distance of two boxes."""
    dx = F.greatest(F.lit(0.0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(F.lit(0.0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return dx * dx + dy * dy


def facing2(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Squared distance two geometries with these boxes cannot exceed; null if the boxes meet on both axes.

    A geometry touches every side of its box. Where the boxes lie apart on one axis,
    the facing sides hold a point each, at most this far from each other.
    """

    def apart(u: str, v: str) -> Column:
        gap = F.greatest(a[f"{u}0"] - b[f"{u}1"], b[f"{u}0"] - a[f"{u}1"])
        wide = F.greatest(a[f"{v}1"] - b[f"{v}0"], b[f"{v}1"] - a[f"{v}0"])
        return F.when(gap >= 0, gap * gap + wide * wide)

    return F.least(apart("x", "y"), apart("y", "x"))


def box(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}_{c}") for c in _BOX}


def within(gap: Column, bound: Column) -> Column:
    """Squared gap at most the squared bound, with room for rounding."""
    return gap <= bound * (1 + 1e-9) + 1e-9


def _reach2(rep: Column) -> Column:
    """Squared distance from the representative to the farthest anchor a left cell can hold."""
    dx = F.greatest(F.abs(rep["ax"] - F.col("a_ax0")), F.abs(rep["ax"] - F.col("a_ax1")))
    dy = F.greatest(F.abs(rep["ay"] - F.col("a_ay0")), F.abs(rep["ay"] - F.col("a_ay1")))
    return dx * dx + dy * dy


def descend(left: Pyramid, right: Pyramid, other_only: bool) -> DataFrame:
    """Pairs of leaves (a, b, bound): every row of ``a`` has its nearest row in one of the ``b``.

    ``bound`` is a squared distance none of a's rows exceeds. With ``other_only`` a
    row must not answer itself, so only cells with two ids bound (one of them is
    another row). A round joins the children of both sides by their parents.
    """
    spark = left.rows.sparkSession
    pairs = spark.range(1).select(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(float("inf")).alias("bound")
    )
    below_a, below_b = left.children("a"), right.children("b")
    reach = _reach2(F.col("b_lo"))
    if other_only:
        reach = F.when(F.col("b_lo.id") != F.col("b_hi.id"), F.greatest(reach, _reach2(F.col("b_hi"))))
    for _ in range(max(len(left.levels), len(right.levels))):
        step = pairs.join(below_a, F.col("a") == F.col("a_parent")).join(below_b, F.col("b") == F.col("b_parent"))
        step = step.withColumn("gap", gap2(box("a"), box("b"))).where(within(F.col("gap"), F.col("bound")))
        step = step.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), "bound", "gap", reach.alias("reach"))
        best = F.least("bound", F.min("reach").over(Window.partitionBy("a")))
        pairs = cut_lineage(step.withColumn("bound", best).where(within(F.col("gap"), F.col("bound"))).select("a", "b", "bound"))
    return pairs
