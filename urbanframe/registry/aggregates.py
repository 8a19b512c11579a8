"""Aggregates, ranking, ordering, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import round_numeric
from urbanframe.operators import advice, dissolve, hierarchy, store_edit
from urbanframe.operators import filters as fl
from urbanframe.operators.ids import dense_id, rank_in_group
from urbanframe.plans import density, occupation
from urbanframe.registry import city, layers, styling
from urbanframe.registry.city import oracle, table
from urbanframe.registry.layers import R


def _surfaces(s, d):
    r = city.relation(s, d, "surfaces")
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return r.select("sid", "k", G.st_rectangle(x0, y0, x1, y1).alias("geom"), G.bbox_struct(x0, y0, x1, y1).alias("bbox"))


def _blocks(s, d, crowd=dissolve.CROWD):
    """Overlapping order squares per nation block: the union counts overlaps once."""
    o = table(s, d, "orders")
    x, y = (F.col("o_orderkey") % 40).cast("double"), (F.col("o_custkey") % 40).cast("double")
    side = (F.col("o_orderkey") % 4 + 1).cast("double")
    o = o.select(
        (F.col("o_custkey") % 25).alias("block"), "o_orderkey", G.st_rectangle(x, y, x + side, y + side).alias("geom"), G.bbox_struct(x, y, x + side, y + side).alias("bbox")
    )
    return dissolve.covered_area(o, ["block"], "geom", crowd)


UNION_SQL = (
    "WITH sq AS (SELECT o_custkey % 25 AS block, o_orderkey % 40 AS x, o_custkey % 40 AS y, o_orderkey % 4 + 1 AS side FROM orders), "
    "cells AS (SELECT DISTINCT block, x + dx.i AS cx, y + dy.i AS cy FROM sq, (VALUES (0), (1), (2), (3)) AS dx(i), (VALUES (0), (1), (2), (3)) AS dy(i) "
    "WHERE dx.i < side AND dy.i < side) SELECT block, CAST(count(*) AS DOUBLE) AS covered_area FROM cells GROUP BY block"
)


def _tall(s, d, limit):
    return city.feature(s, d).where((F.col("objectclass_id") == 901) & (G.st_height("envelope") < limit)).select("id")


def _class_tree_counts(s, d):
    """Features per subclass of a root class."""
    sub = hierarchy.class_closure(city.dictionary(s, "objectclass"), 12, skip_abstract=True)
    f = city.feature(s, d)
    return f.join(sub.withColumnRenamed("id", "objectclass_id"), "objectclass_id").groupBy("objectclass_id").agg(F.count(F.lit(1)).alias("features"))


SUBCLASSES = (
    "WITH RECURSIVE sub AS (SELECT id, is_abstract FROM objectclass WHERE id = 12 UNION ALL SELECT c.id, c.is_abstract FROM objectclass c JOIN sub ON c.superclass_id = sub.id) "
    "SELECT objectclass_id, count(*) AS features FROM features WHERE objectclass_id IN (SELECT id FROM sub WHERE id <> 12 AND is_abstract <> 1) GROUP BY objectclass_id"
)

ENTRIES = {
    "class_counts": (
        lambda s, d: city.class_geometries(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total")),
        oracle("SELECT o.classname AS class, count(*) AS total FROM features f JOIN objectclass o ON o.id = f.objectclass_id WHERE f.xmin IS NOT NULL GROUP BY o.classname", "features", "objectclass"),
    ),
    "count_distinct_buildings": (
        lambda s, d: layers.occupation_inputs(s, d)[1].groupBy("parcel_id").agg(F.countDistinct("building_gml_id").alias("buildings")),
        layers._p("SELECT parcel_id, count(DISTINCT building_gml_id) AS buildings FROM pieces GROUP BY parcel_id"),
    ),
    "parcel_far_agg": (
        lambda s, d: density.parcel_far_agg(layers.estimates_layer(s, d)).select(
            "parcel_id", "buildings_count", round_numeric("occupied_area_m2", 2).alias("occupied_area_m2"),
            round_numeric("estimated_floor_area_m2", 2).alias("estimated_floor_area_m2"), "max_building_height_m", "max_estimated_floors",
            round_numeric("avg_estimated_floors", 3).alias("avg_estimated_floors"),
        ),
        layers._p(
            f"SELECT parcel_id, n AS buildings_count, {R('occ', 2)} AS occupied_area_m2, {R('fa', 2)} AS estimated_floor_area_m2, mh AS max_building_height_m, "
            f"mf AS max_estimated_floors, {R('af', 3)} AS avg_estimated_floors FROM far_sums", layers.FAR_CTES,
        ),
    ),
    "geometry_collect": (
        lambda s, d: _surfaces(s, d).groupBy("k").agg(G.collect_parts("geom").alias("g")).select(
            "k", F.size("g.parts").alias("parts"), G.st_area("g").alias("area"), G.st_npoints("g").alias("points")
        ),
        oracle("SELECT k, CAST(count(*) AS INTEGER) AS parts, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area, CAST(count(*) * 5 AS INTEGER) AS points FROM surfaces GROUP BY k", "surfaces"),
    ),
    "union_area_agg": (_blocks, UNION_SQL),
    "union_area_hot_groups": (lambda s, d: _blocks(s, d, 4).withColumn("covered_area", round_numeric("covered_area", 4)), UNION_SQL),
    "extent_agg": (
        lambda s, d: _surfaces(s, d).groupBy("k").agg(G.extent_agg(F.col("bbox")).alias("e")).select("k", "e.xmin", "e.ymin", "e.xmax", "e.ymax"),
        oracle("SELECT k, CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin, CAST(max(x1) AS DOUBLE) AS xmax, CAST(max(y1) AS DOUBLE) AS ymax FROM surfaces GROUP BY k", "surfaces"),
    ),
    "vertex_stats": (
        lambda s, d: advice.vertex_stats(city.geometry_data(s, d), city.feature(s, d), city.dictionary(s, "objectclass"), by_class=True),
        oracle(
            "SELECT o.classname, CASE WHEN o.classname IS NOT NULL THEN 5 END AS min_vertices, CASE WHEN o.classname IS NOT NULL THEN 5 END AS max_vertices, "
            "CASE WHEN o.classname IS NOT NULL THEN CAST(5 AS DOUBLE) END AS avg_vertices, count(*) AS geometries_total FROM geometries g LEFT JOIN features f ON f.id = g.feature_id "
            "LEFT JOIN objectclass o ON o.id = f.objectclass_id GROUP BY o.classname", "geometries", "features", "objectclass",
        ),
    ),
    "max_features_per_tile": (
        lambda s, d: advice.max_features_per_tile(advice.vertex_stats(city.geometry_data(s, d), city.feature(s, d), city.dictionary(s, "objectclass"))),
        oracle(
            "SELECT 5 AS min_vertices, 5 AS max_vertices, CAST(5 AS DOUBLE) AS avg_vertices, count(*) AS geometries_total, 2000 AS max_features_per_tile FROM geometries", "geometries",
        ),
    ),
    "filtered_array_agg": (
        lambda s, d: city.store_table(s, d, "surface_data").groupBy((F.col("id") % 10).alias("bucket")).agg(
            F.array_sort(F.collect_list("x3d_emissive_color")).alias("e"), F.array_sort(F.collect_list("x3d_diffuse_color")).alias("c")
        ).select("bucket", F.when(F.size("e") > 0, F.array_join("e", ",")).alias("emissive"), F.when(F.size("c") > 0, F.array_join("c", ",")).alias("diffuse")),
        oracle(
            "SELECT id % 10 AS bucket, string_agg(x3d_emissive_color, ',' ORDER BY x3d_emissive_color) AS emissive, "
            "string_agg(x3d_diffuse_color, ',' ORDER BY x3d_diffuse_color) AS diffuse FROM surface_datas GROUP BY id % 10", "surface_datas",
        ),
    ),
    "class_property_map": (
        lambda s, d: advice.class_property_map(city.store(s, d)),
        oracle(
            f"WITH {styling.CLASS_KEYS}, lists AS (SELECT classname, '[' || string_agg(coalesce('\"' || key || '\"', 'null'), ',' ORDER BY key NULLS LAST) || ']' AS l "
            "FROM class_keys GROUP BY classname) SELECT '{' || string_agg('\"' || classname || '\":{\"properties\":' || l || '}', ',' ORDER BY classname) || '}' AS properties_by_class FROM lists",
            "features", "properties", "geometries", "objectclass", "namespace",
        ),
    ),
    "wps_aggregate": (
        lambda s, d: table(s, d, "customer").agg(
            F.count("c_acctbal").alias("Count"), round_numeric(F.avg("c_acctbal"), 4).alias("Average"), round_numeric(F.sum("c_acctbal"), 2).alias("Sum"),
            F.min("c_acctbal").alias("Min"), F.max("c_acctbal").alias("Max"),
        ),
        f"SELECT count(c_acctbal) AS \"Count\", {R('avg(c_acctbal)', 4)} AS \"Average\", {R('sum(c_acctbal)', 2)} AS \"Sum\", min(c_acctbal) AS \"Min\", max(c_acctbal) AS \"Max\" FROM customer",
    ),
    "wps_aggregate_groupby": (
        lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("Count"), round_numeric(F.avg("c_acctbal"), 4).alias("Average")),
        f"SELECT c_mktsegment, count(c_acctbal) AS \"Count\", {R('avg(c_acctbal)', 4)} AS \"Average\" FROM customer GROUP BY c_mktsegment",
    ),
    # ---- ranking and ordering
    "rank_parcel_per_building": (
        lambda s, d: layers.occupation_inputs(s, d)[1].select("gid", "parcel_id", "intersection_area_m2", "parcel_rank"),
        layers._p("SELECT gid, parcel_id, intersection_area_m2, parcel_rank FROM pieces"),
    ),
    "rank_in_group": (
        lambda s, d: rank_in_group(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "rank"),
        "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem",
    ),
    "primary_parcel": (
        lambda s, d: layers.occupation_inputs(s, d)[1].where("parcel_rank = 1").select("gid", "parcel_id"),
        layers._p("SELECT gid, parcel_id FROM pieces WHERE parcel_rank = 1"),
    ),
    "dense_gid": (
        lambda s, d: dense_id(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "gid"),
        "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS gid, o_orderkey, o_totalprice FROM orders",
    ),
    "unordered_gid": (
        lambda s, d: layers.points_layer(s, d).select("gid", "source_id"),
        layers._g("SELECT gid, source_id FROM pts"),
    ),
    "top_k": (
        lambda s, d: fl.top_k(layers.fos_layer(s, d), [F.desc("fos_pct"), F.asc("parcel_id")], 20, ["parcel_id", "buildings_count", "occupied_area_m2", "fos_pct", "fos_level"]),
        layers._p("SELECT parcel_id, buildings_count, occupied_area_m2, fos_pct, fos_level FROM fos ORDER BY fos_pct DESC, parcel_id LIMIT 20", layers.FOS_CTES),
    ),
    "order_nulls_last": (
        lambda s, d: fl.top_k(
            table(s, d, "part").withColumn("r", F.col("p_size") / F.nullif((F.col("p_partkey") % 5).cast("double"), F.lit(0.0))),
            [F.desc_nulls_last("r"), F.asc("p_partkey")], 100, ["p_partkey", "r"],
        ),
        "SELECT p_partkey, p_size / nullif(CAST(p_partkey % 5 AS DOUBLE), 0) AS r FROM part ORDER BY r DESC NULLS LAST, p_partkey LIMIT 100",
    ),
    "order_nulls_first": (
        lambda s, d: fl.top_k(
            table(s, d, "part").withColumn("r", F.col("p_size") / F.nullif((F.col("p_partkey") % 5).cast("double"), F.lit(0.0))),
            [F.desc_nulls_first("r"), F.asc("p_partkey")], 100, ["p_partkey", "r"],
        ),
        "SELECT p_partkey, p_size / nullif(CAST(p_partkey % 5 AS DOUBLE), 0) AS r FROM part ORDER BY r DESC NULLS FIRST, p_partkey LIMIT 100",
    ),
    # ---- set operations and recursion
    "union_all_geometries": (
        lambda s, d: city.geometry_data(s, d).where("geometry is not null").select("id", G.st_area("geometry").alias("area")).unionByName(
            city.geometry_data(s, d).where("implicit_geometry is not null").select("id", G.st_area("implicit_geometry").alias("area"))
        ),
        oracle("SELECT id, (gx1 - gx0) * (gy1 - gy0) AS area FROM geometries WHERE gx0 IS NOT NULL UNION ALL SELECT id, tx1 * ty1 FROM geometries WHERE tx1 IS NOT NULL", "geometries"),
    ),
    "union_ids": (
        lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("id")).union(table(s, d, "customer").select("c_custkey")).distinct(),
        "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer",
    ),
    "intersect_ids": (
        lambda s, d: store_edit.intersect_then_union(
            table(s, d, "orders").select(F.col("o_custkey").alias("id")), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")),
            table(s, d, "supplier").select(F.col("s_suppkey").alias("id")),
        ),
        "(SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION SELECT s_suppkey FROM supplier",
    ),
    "class_closure": (_class_tree_counts, oracle(SUBCLASSES, "features", "objectclass")),
    "property_subtree": (
        lambda s, d: hierarchy.property_subtree(city.property_rows(s, d), city.property_rows(s, d).where("name in ('height', 'storeys')").select("id")),
        oracle(
            "WITH RECURSIVE sub AS (SELECT id FROM properties WHERE name IN ('height', 'storeys') UNION SELECT p.id FROM properties p JOIN sub ON p.parent_id = sub.id) SELECT id FROM sub",
            "properties",
        ),
    ),
    "feature_subtree": (
        lambda s, d: hierarchy.feature_subtree(city.property_rows(s, d), _tall(s, d, 20.0)),
        oracle(
            "WITH RECURSIVE sub AS (SELECT id FROM features WHERE objectclass_id = 901 AND zmax - zmin < 20 UNION "
            "SELECT p.val_feature_id FROM properties p JOIN sub ON p.feature_id = sub.id WHERE p.val_relation_type = 1) SELECT id FROM sub", "features", "properties",
        ),
    ),
}
