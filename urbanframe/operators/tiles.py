"""Quadtree tiles with additive refinement, and their content.

Rule: the root is a square around the extent of all envelope centres. Each tile
keeps its N largest features (by box area, then id); the others go down to the
child that holds their centre, as deep as it takes for every tile to meet its N.
Centres are told apart to a 2^-30 part of the root; what has one centre cannot be
divided, so its tile keeps all of it.

No tile travels as a whole. All features get their place in the order of size
once, by a range sort. Per level each task counts its features by tile and bucket
of places; the running counts give the bucket that holds a tile's N-th feature,
and only that bucket's features (the square root of all, at most) are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.projection import st_transform
from urbanframe.operators.ids import dense_id
from urbanframe.schema import WGS84
from urbanframe.session import cut_lineage

#: Bits of a centre on each axis, and so the deepest level there can be.
BITS = 30
# Fixed manifest values: refinement, root error, levels per subtree file.
GEOMETRIC_ERROR = 2000.0
SUBTREE_LEVELS = 4


def _placed(df: DataFrame, groups: list[str], key: str, geom: str, carried: list[str], few: bool) -> DataFrame:
    """The rows with a box: place in the order of size ``_pos``, and the bits of their centre inside the root of their group.

    The roots of ``few`` groups are broadcast: a shuffle by group would put all rows of a class into one task, and
    its one file would keep them together through all rounds.
    """
    mid = lambda a: ((F.col(f"_b.{a}min") + F.col(f"_b.{a}max")) / 2).alias(f"_c{a}")
    rows = df.select(*groups, key, *carried, G.st_bbox(geom).alias("_b")).where(F.col("_b").isNotNull())
    rows = rows.select(*groups, key, *carried, mid("x"), mid("y"), G.bbox_area(F.col("_b")).alias("_area"))
    rows = dense_id(rows, [F.desc("_area"), F.asc(key), "_cx", "_cy"], "_pos", start=0)
    rows = cut_lineage(rows.drop("_area"))
    frame = rows.groupBy(*groups).agg(
        F.min("_cx").alias("_x0"), F.min("_cy").alias("_y0"),
        F.greatest(F.max("_cx") - F.min("_cx"), F.max("_cy") - F.min("_cy"), F.lit(1e-9)).alias("_side"),
    )
    if groups:
        rows = rows.join(F.broadcast(frame) if few else frame, groups)
    else:
        rows = rows.withColumn("_e", frame.select(F.struct("_x0", "_y0", "_side")).scalar()).select("*", "_e.*").drop("_e")
    last = F.lit((1 << BITS) - 1).cast("long")
    bits = lambda a: F.least(F.floor((F.col(f"_c{a}") - F.col(f"_{a}0")) / F.col("_side") * float(1 << BITS)), last).alias(f"_{a}")
    return rows.select(*groups, key, *carried, "_pos", bits("x"), bits("y"))


def quadtree_tiles(
    df: DataFrame, max_features: int | dict[str, int], key: str = "id", geom: str = "geom",
    group: str | None = None, max_level: int = BITS, carried: list[str] | None = None,
) -> DataFrame:
    """(group, key, carried, level, x, y): the tile of every feature.

    ``group`` builds one tree per group value, with a budget per value given as
    a dict. At ``max_level``, if given, tiles keep all that is left.
    """
    groups, carried, few = [group] if group else [], carried or [], isinstance(max_features, dict)
    if few:
        df = df.where(F.col(group).isin(list(max_features)))
        limit = F.create_map(*[F.lit(v) for kv in max_features.items() for v in kv])[F.col(group)]
    else:
        limit = F.lit(max_features)
    rest = cut_lineage(_placed(df, groups, key, geom, carried, few))
    width = max(1, math.isqrt(rest.count()))
    rest = rest.withColumn("_bucket", F.expr(f"_pos div {width}"))
    tile, out = [*groups, "level", "x", "y"], None
    for level in range(max_level + 1):
        here = rest.withColumns({"level": F.lit(level), "x": F.shiftright("_x", BITS - level), "y": F.shiftright("_y", BITS - level)})
        if level == max_level:
            out = _also(out, here)
            break
        sums = here.groupBy(*tile, "_bucket").agg(
            F.count(F.lit(1)).alias("_n"), *[fn(c).alias(f"{c}{e}") for c in ("_x", "_y") for fn, e in ((F.min, "0"), (F.max, "1"))]
        )
        whole = Window.partitionBy(*tile)
        ahead = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        one = (F.min("_x0").over(whole) == F.max("_x1").over(whole)) & (F.min("_y0").over(whole) == F.max("_y1").over(whole))
        sums = sums.withColumns({"_ahead": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "_all": F.sum("_n").over(whole), "_one": one, "_cap": limit})
        cut = sums.where("NOT _one AND _all > _cap AND _ahead < _cap AND _ahead + _n >= _cap")
        cut = cut_lineage(cut.select(*tile, "_bucket", (F.col("_cap") - F.col("_ahead")).alias("_need")))
        if cut.isEmpty():
            out = _also(out, here)
            break
        rank = F.row_number().over(Window.partitionBy(*tile).orderBy("_pos"))
        ranked = here.select(*tile, "_bucket", "_pos").join(cut, [*tile, "_bucket"]).withColumn("_rank", rank)
        last = cut_lineage(ranked.where("_rank = _need").select(*tile, F.col("_pos").alias("_last")))
        stays = F.col("_last").isNull() | (F.col("_pos") <= F.col("_last"))
        marked = cut_lineage(here.join(last, tile, "left").withColumn("_stays", stays).drop("_last"))
        out = _also(out, marked.where("_stays").drop("_stays"))
        rest = marked.where("NOT _stays").drop("_stays", "level", "x", "y")
    return out.select(*groups, key, *carried, "level", "x", "y")


def _also(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def separate_tilesets(
    df: DataFrame, budgets: dict[str, int], key: str = "id", geom: str = "geom", column: str = "class", carried: list[str] | None = None
) -> DataFrame:
    """One tree per class, each with its own budget, built together."""
    return quadtree_tiles(df, budgets, key, geom, column, carried=carried)


def tile_content(df: DataFrame, budgets: dict[str, int], key: str = "id", geom: str = "geom", column: str = "class") -> DataFrame:
    """Every feature with all its columns and its tile (level, x, y) in the tree of its class.

    The layer is written once with a number for each row, so repeated keys keep
    their own tiles and only keys and centres go through the rounds.
    """
    rows = cut_lineage(df.where(F.col(column).isin(list(budgets))).withColumn("_row", F.monotonically_increasing_id()))
    placed = separate_tilesets(rows, budgets, key, geom, column, ["_row"]).select("_row", "level", "x", "y")
    return rows.join(placed, "_row").drop("_row")


def write_tile_content(content: DataFrame, path: str, column: str = "class") -> None:
    """Write content partitioned by class; the classes in it replace their former content, all others stay.

    A class is one partition, so no level of a former tree is left behind; inside
    it rows are sorted by level and tile, and a reader of one level skips the rest.
    """
    rows = content.repartitionByRange(column, "level", "x", "y").sortWithinPartitions(column, "level", "x", "y")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_tile_content(spark, path: str, classes: list[str] | None = None, level: int | None = None, column: str = "class") -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col(column).isin(classes)) if classes is not None else df
    return df.where(F.col("level") == level) if level is not None else df


def morton(x: Column, y: Column, bits: int) -> Column:
    """Interleaved bits of a tile position."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        xb = F.shiftright(x, b).bitwiseAND(1)
        yb = F.shiftright(y, b).bitwiseAND(1)
        out = out + F.shiftleft(xb, 2 * b) + F.shiftleft(yb, 2 * b + 1)
    return out


def subtree_availability(tiles: DataFrame, levels: int = SUBTREE_LEVELS) -> DataFrame:
    """Existing tiles per subtree: (root_level, root_x, root_y, level, available).

    A subtree spans four levels, so a list holds at most 64 positions.
    """
    t = tiles.select("level", "x", "y").distinct()
    up = (F.col("level") % levels).cast("int")
    root = t.withColumns({
        "root_level": F.col("level") - up, "_up": up,
    })
    rx = F.expr("shiftright(x, _up)")
    ry = F.expr("shiftright(y, _up)")
    root = root.withColumns({"root_x": rx, "root_y": ry})
    local_x = F.col("x") - F.expr("shiftleft(root_x, _up)")
    local_y = F.col("y") - F.expr("shiftleft(root_y, _up)")
    root = root.withColumn("_m", morton(local_x, local_y, levels))
    return root.groupBy("root_level", "root_x", "root_y", "level").agg(F.array_sort(F.collect_set("_m")).alias("available"))


def tileset_manifest(df: DataFrame, tiles: DataFrame, geom: str = "geom") -> DataFrame:
    """One-row manifest: root region in radians, heights, levels and file templates."""
    box = df.select(G.st_bbox(geom).alias("_b"), F.col(f"{geom}.srid").alias("_s")).where("_b is not null")
    one = box.agg(G.extent_agg(F.col("_b")).alias("e"), F.min("_s").alias("s"))
    frame = G.st_rectangle(F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax"), F.col("e.ymax"), srid=F.col("s"))
    one = one.withColumn("w", G.st_bbox(st_transform(frame, WGS84)))
    region = F.array(
        F.radians("w.xmin"), F.radians("w.ymin"), F.radians("w.xmax"), F.radians("w.ymax"), F.col("e.zmin"), F.col("e.zmax")
    )
    levels = tiles.select(F.max("level") + 1).scalar()
    tiling = F.struct(
        levels.cast("int").alias("availableLevels"), F.lit("QUADTREE").alias("subdivisionScheme"),
        F.lit(SUBTREE_LEVELS).alias("subtreeLevels"),
        F.struct(F.lit("subtrees/{level}_{x}_{y}.subtree").alias("uri")).alias("subtrees"),
    )
    root = F.struct(
        F.lit(GEOMETRIC_ERROR).alias("geometricError"), F.lit("ADD").alias("refine"),
        F.struct(region.alias("region")).alias("boundingVolume"),
        F.struct(F.lit("content/{level}_{x}_{y}.glb").alias("uri")).alias("content"), tiling.alias("implicitTiling"),
    )
    asset = F.struct(F.lit("1.1").alias("version"))
    doc = F.struct(asset.alias("asset"), F.lit(GEOMETRIC_ERROR).alias("geometricError"), root.alias("root"))
    return one.select(F.to_json(doc).alias("tileset"))
