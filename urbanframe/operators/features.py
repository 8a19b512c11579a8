"""Feature requests and edits on layer tables, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K


def query_features(
    df: DataFrame,
    columns: list[str] | None = None,
    where: Column | str | None = None,
    fids: Iterable | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    point: tuple[float, float] | None = None,
    not_disjoint: Column | None = None,
    limit: int | None = None,
    key: str = "id",
    geom: str = "geom",
    box: str = "bbox",
) -> DataFrame:
    """One request: ids, attribute filter, spatial filter, projection, cap.

    Spatial filters test the stored box first, so most rows are dropped before
    their geometry is read. ``where`` is a Column or a SQL condition text.
    """
    if fids is not None:
        df = df.where(F.col(key).isin(list(fids)))
    if where is not None:
        df = df.where(where)
    if bbox is not None:
        window = G.bbox_struct(*bbox)
        frame = G.st_rectangle(*bbox, srid=F.col(geom)["srid"])
        df = df.where(G.bbox_overlaps(F.col(box), window)).where(K.st_intersects(F.col(geom), frame))
    if point is not None:
        x, y = point
        df = df.where(G.bbox_overlaps(F.col(box), G.bbox_struct(x, y, x, y))).where(G.contains_point(geom, x, y))
    if not_disjoint is not None:
        df = df.where(G.bbox_overlaps(F.col(box), G.st_bbox(not_disjoint))).where(K.st_intersects(F.col(geom), not_disjoint))
    if limit is not None:
        df = df.orderBy(key).limit(limit)
    return df.select(*columns) if columns else df


def query_layers(requests: dict[str, tuple[DataFrame, Column | str]]) -> DataFrame:
    """Several layers in one answer, each with its own filter; missing columns are null."""
    out = None
    for name, (df, cond) in requests.items():
        part = df.where(cond).withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def insert_features(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def update_features(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """New values where the condition holds; an unknown condition leaves the row alone."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_features_where(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def apply_style(df: DataFrame, rules: list[tuple[Column, str]], otherwise: str | None, name: str = "style") -> DataFrame:
    """First matching rule gives the style; the last one is the else rule."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return df.withColumn(name, out.otherwise(F.lit(otherwise)))


def recode(value: Column, mapping: dict) -> Column:
    """Literal lookup; values outside the mapping give null."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), value)


# Fixed colours of the published styles.
HEIGHT_COLOURS = {"muy_alto": "#e74c3c", "alto": "#f39c12", "medio": "#3498db"}
HEIGHT_ELSE = "#95a5a6"
FOS_COLOURS = {"HIGH": "#ef4444", "MEDIUM": "#f97316", "LOW": "#22c55e"}
FOS_ELSE = "#94a3b8"
MAP_COLOURS = {
    1: "#8dd3c7", 2: "#ffffb3", 3: "#bebada", 4: "#fb8072", 5: "#80b1d3", 6: "#fdb462", 7: "#b3de69", 8: "#fccde5",
}


def style_heights(df: DataFrame) -> DataFrame:
    rules = [(F.col("height_category") == c, colour) for c, colour in HEIGHT_COLOURS.items()]
    return apply_style(df, rules, HEIGHT_ELSE)


def style_occupation(df: DataFrame) -> DataFrame:
    rules = [(F.col("fos_level") == c, colour) for c, colour in FOS_COLOURS.items()]
    return apply_style(df, rules, FOS_ELSE)
