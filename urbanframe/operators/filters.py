"""Predicates and projections on feature and layer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G


def class_filter(df: DataFrame, classname: str, column: str = "class") -> DataFrame:
    return df.where(F.col(column) == classname)


def exclude_classes(df: DataFrame, names: list[str], column: str = "class") -> DataFrame:
    """Drop the listed classes; rows without a class are dropped too, as in SQL NOT IN."""
    return df.where(~F.col(column).isin(names))


def drop_geometry_type(df: DataFrame, kind: str = "MultiLineString", geom: str = "geom") -> DataFrame:
    return df.where(G.st_geometrytype(geom) != kind)


def non_empty_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.where(G.not_empty(geom))


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def toplevel_only(feature: DataFrame, objectclass: DataFrame) -> DataFrame:
    """Features of top-level classes."""
    top = objectclass.where(F.col("is_toplevel") > 0).select(F.col("id").alias("objectclass_id"))
    return feature.join(top, "objectclass_id", "left_semi")


def distinct_layer(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in an explicit order; rows beyond the first never reach the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Control: keys that occur more than once (none expected)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def top_k(df: DataFrame, order: list[Column], k: int, columns: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(k).select(*columns)
