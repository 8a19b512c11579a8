"""Geometry statistics and tile advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import concat_nulls_empty, round_numeric
from urbanframe.operators.filters import toplevel_only

VERTEX_BUDGET = 10_000
BUDGET_FACTOR = 5
# Data types of geometry and feature properties (fixed ids), not listed as attributes.
LINK_TYPES = (10, 11)


def _vertex_aggs() -> list[Column]:
    n = F.col("_n")
    return [
        F.min(n).alias("min_vertices"), F.max(n).alias("max_vertices"), F.avg(n).alias("_avg"),
        F.count(F.lit(1)).alias("geometries_total"),
    ]


def _with_class(geometry_data: DataFrame, feature: DataFrame, objectclass: DataFrame) -> DataFrame:
    f = feature.select(F.col("id").alias("feature_id"), "objectclass_id")
    oc = objectclass.select(F.col("id").alias("objectclass_id"), "classname")
    return (
        geometry_data.select("feature_id", G.st_npoints("geometry").alias("_n"))
        .join(f, "feature_id", "left").join(oc, "objectclass_id", "left")
    )


def vertex_stats(geometry_data: DataFrame, feature: DataFrame, objectclass: DataFrame, by_class: bool = False) -> DataFrame:
    """Smallest, largest, average vertex count and number of geometries; overall or per class."""
    rows = _with_class(geometry_data, feature, objectclass)
    out = rows.groupBy("classname").agg(*_vertex_aggs()) if by_class else rows.agg(*_vertex_aggs())
    head = ["classname"] if by_class else []
    return out.select(*head, "min_vertices", "max_vertices", round_numeric("_avg", 2).alias("avg_vertices"), "geometries_total")


def max_features_per_tile(stats: DataFrame) -> DataFrame:
    """Budget over the average that is already rounded to two digits."""
    rec = F.round(F.lit(float(VERTEX_BUDGET)) / F.col("avg_vertices")).cast("int")
    return stats.withColumn("max_features_per_tile", rec)


def max_features_unrounded(geometry_data: DataFrame, feature: DataFrame | None = None, objectclass: DataFrame | None = None) -> DataFrame:
    """Budget over the exact average; with classes given, top-level features only."""
    rows = geometry_data
    if feature is not None:
        top = toplevel_only(feature, objectclass).select(F.col("id").alias("feature_id"))
        rows = rows.join(top, "feature_id", "left_semi")
    s = rows.select(G.st_npoints("geometry").alias("_n")).agg(F.avg("_n").alias("avg_vertice_number"), F.min("_n").alias("min_vertice_number"), F.max("_n").alias("max_vertice_number"))
    rec = F.round(F.lit(float(VERTEX_BUDGET)) / F.col("avg_vertice_number")).cast("int")
    return s.withColumn("max_features_per_tile", rec)


def tile_budget(recommended: Column) -> Column:
    return recommended * BUDGET_FACTOR


def class_property_keys(store: dict[str, DataFrame]) -> DataFrame:
    """Distinct property keys per class of features that own a geometry.

    Rows shrink to distinct (class, parent, name) ids before the dictionary joins.
    """
    owners = store["geometry_data"].select(F.col("feature_id").alias("id")).where("id is not null")
    f = store["feature"].join(owners, "id", "left_semi").select(F.col("id").alias("feature_id"), "objectclass_id")
    p = store["property"].where(~F.col("datatype_id").isin(*LINK_TYPES)).select(
        "feature_id", "parent_id", F.col("namespace_id").alias("_n1"), F.col("name").alias("_p1")
    )
    parent = store["property"].select(
        F.col("id").alias("parent_id"), F.col("namespace_id").alias("_n2"), F.col("name").alias("_p2")
    )
    own = f.join(p, "feature_id", "left")
    ids = (
        # most properties have no parent: only those that do look for its name
        own.where("parent_id is not null").join(parent, "parent_id", "left")
        .unionByName(own.where("parent_id is null"), allowMissingColumns=True)
        .select("objectclass_id", "_n1", "_p1", "_n2", "_p2").distinct()
    )
    oc = store["objectclass"].select(F.col("id").alias("objectclass_id"), "classname")
    ns = store["namespace"]
    for n in ("1", "2"):
        ids = ids.join(ns.select(F.col("id").alias(f"_n{n}"), F.col("alias").alias(f"_a{n}")), f"_n{n}", "left")
    ids = ids.join(oc, "objectclass_id", "left")
    own = concat_nulls_empty("_a1", F.lit("__"), "_p1")
    up = concat_nulls_empty("_a2", F.lit("__"), "_p2")
    key = F.when(up == "__", F.nullif(own, F.lit("__"))).otherwise(F.concat(up, F.lit("."), own))
    return ids.select("classname", key.alias("key")).distinct()


def class_properties(store: dict[str, DataFrame]) -> DataFrame:
    """One row per class with its sorted property keys (null kept, last)."""
    keys = class_property_keys(store)
    listed = F.array_sort(F.collect_list(F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("key"))))
    return keys.groupBy("classname").agg(F.transform(listed, lambda s: s["key"]).alias("properties"))


def class_property_map(store: dict[str, DataFrame]) -> DataFrame:
    """One JSON document: class name to its properties (as many entries as classes)."""
    entry = F.struct(F.coalesce("classname", F.lit("")).alias("k"), F.struct("properties").alias("v"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return class_properties(store).agg(F.to_json(whole).alias("properties_by_class"))


def advise(store: dict[str, DataFrame], commandset: dict[str, str] | None = None, by_class: bool = False) -> DataFrame:
    """Advice document: command set, recommended features per tile, classes with properties."""
    args = (store["geometry_data"], store["feature"], store["objectclass"])
    props = class_properties(store).withColumnRenamed("classname", "name")
    if by_class:
        rec = max_features_per_tile(vertex_stats(*args, by_class=True)).select(
            F.col("classname").alias("name"), F.col("max_features_per_tile").alias("objectclass_recommendations")
        )
        props = props.join(rec, "name", "left")
        overall = F.lit(None).cast("int")
    else:
        props = props.withColumn("objectclass_recommendations", F.lit(None).cast("int"))
        overall = max_features_per_tile(vertex_stats(*args)).select("max_features_per_tile").scalar()
    cmd = F.create_map(*[F.lit(str(x)) for kv in (commandset or {}).items() for x in kv]) if commandset else F.lit(None).cast("map<string,string>")
    classes = F.array_sort(F.collect_list(F.struct("name", "objectclass_recommendations", "properties")))
    return props.agg(classes.alias("objectclasses")).select(cmd.alias("commandset"), overall.alias("max_features"), "objectclasses")
