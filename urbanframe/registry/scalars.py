"""Scalar functions: math, text, JSON, arrays, null handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions.scalars import concat_nulls_empty, hex_byte, json_or_null, number_text, one_or_null, round_numeric
from urbanframe.operators.envelopes import parse_matrix
from urbanframe.operators.store_edit import metadata_timestamp
from urbanframe.registry import city
from urbanframe.registry.city import oracle, table
from urbanframe.registry.layers import R


def _part(s, d):
    return table(s, d, "part")


def _events(s, d):
    return table(s, d, "events")


def _surface(s, d):
    return city.store_table(s, d, "surface_data")


ANGLE = "CAST(p_partkey % 720 AS DOUBLE)"

ENTRIES = {
    "trig_math": (
        lambda s, d: _part(s, d).withColumn("a", (F.col("p_partkey") % 720).cast("double")).select(
            "p_partkey", round_numeric(F.sin(F.radians("a")), 4).alias("sine"), round_numeric(F.cos(F.radians("a")), 4).alias("cosine"),
            round_numeric(F.tan(F.radians((F.col("a") % 80) + 1)), 4).alias("tangent"), (F.col("a") + 180 - 360 * F.floor((F.col("a") + 180) / 360)).alias("turned"),
        ),
        f"SELECT p_partkey, {R(f'sin(radians({ANGLE}))', 4)} AS sine, {R(f'cos(radians({ANGLE}))', 4)} AS cosine, "
        f"{R(f'tan(radians({ANGLE} % 80 + 1))', 4)} AS tangent, {ANGLE} + 180 - 360 * floor(({ANGLE} + 180) / 360) AS turned FROM part",
    ),
    "least_greatest": (
        lambda s, d: _part(s, d).select(
            "p_partkey", F.least("p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit(20))).alias("lo"), F.greatest("p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit(20))).alias("hi")
        ),
        "SELECT p_partkey, least(p_size, CASE WHEN p_partkey % 2 = 0 THEN 20 END) AS lo, greatest(p_size, CASE WHEN p_partkey % 2 = 0 THEN 20 END) AS hi FROM part",
    ),
    "cast_text": (
        lambda s, d: _part(s, d).select("p_partkey", number_text(F.col("p_retailprice")).alias("price"), F.col("p_partkey").cast("string").alias("key"), F.col("p_retailprice").cast("int").alias("whole")),
        "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price, "
        "CAST(p_partkey AS VARCHAR) AS key, CAST(trunc(p_retailprice) AS INTEGER) AS whole FROM part",
    ),
    "string_concat": (
        lambda s, d: _part(s, d).withColumn("ns", F.when(F.col("p_size") > 25, F.col("p_brand"))).select(
            "p_partkey", F.nullif(concat_nulls_empty("ns", F.lit("__"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), F.lit("__")).alias("key")
        ),
        "SELECT p_partkey, nullif(concat(CASE WHEN p_size > 25 THEN p_brand END, '__', CASE WHEN p_size % 2 = 0 THEN p_type END), '__') AS key FROM part",
    ),
    "hex_colour": (
        lambda s, d: _part(s, d).select("p_partkey", hex_byte((F.col("p_partkey") % 101) / F.lit(100.0)).alias("channel")),
        "SELECT p_partkey, lower(to_hex(CAST(round((p_partkey % 101) / 100.0 * 256, 0) AS BIGINT))) AS channel FROM part",
    ),
    "json_build": (
        lambda s, d: _part(s, d).select(
            "p_partkey", json_or_null(one_or_null(F.when(F.col("p_size") > 20, F.col("p_brand"))).alias("brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("type")).alias("doc")
        ),
        "SELECT p_partkey, CASE WHEN p_size > 20 AND p_size % 2 = 0 THEN '{\"brand\":[\"' || p_brand || '\"],\"type\":\"' || p_type || '\"}' "
        "WHEN p_size > 20 THEN '{\"brand\":[\"' || p_brand || '\"]}' WHEN p_size % 2 = 0 THEN '{\"type\":\"' || p_type || '\"}' END AS doc FROM part",
    ),
    "json_explode": (
        lambda s, d: _events(s, d).select("event_id", F.explode(F.json_object_keys("props")).alias("key"), F.get_json_object("props", "$.k").cast("int").alias("value")),
        "SELECT event_id, unnest(json_keys(props)) AS key, CAST(props->>'k' AS INTEGER) AS value FROM events",
    ),
    "json_array_elements": (
        lambda s, d: city.property_rows(s, d).where("val_array is not null").select("id", F.posexplode(F.from_json("val_array", "array<double>")).alias("pos", "value")),
        oracle(
            "SELECT id, CAST(unnest(range(16)) AS INTEGER) AS pos, CAST(unnest([2, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]) AS DOUBLE) AS value FROM properties WHERE val_array IS NOT NULL", "properties",
        ),
    ),
    "json_check": (
        lambda s, d: city.property_rows(s, d).where("val_implicitgeom_id is not null").select("id", F.size(parse_matrix(F.col("val_array"))).alias("n")),
        oracle("SELECT id, 16 AS n FROM properties WHERE val_implicitgeom_id IS NOT NULL", "properties"),
    ),
    "array_ops": (
        lambda s, d: _surface(s, d).select(
            "id", F.size(F.array_distinct(F.array_compact(F.array("x3d_emissive_color", "x3d_specular_color", "x3d_emissive_color")))).alias("colours"),
            one_or_null(F.col("x3d_diffuse_color"))[0].alias("first"),
        ),
        oracle(
            "SELECT id, CAST(CASE WHEN x3d_emissive_color IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN x3d_specular_color IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS colours, "
            "x3d_diffuse_color AS first FROM surface_datas", "surface_datas",
        ),
    ),
    "metadata_override": (
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", metadata_timestamp({"termination_date": "2024-02-03 04:05:06"}, "termination_date", F.col("o_orderdate")).cast("string").alias("ended"),
            metadata_timestamp({"termination_date": "soon"}, "termination_date", F.col("o_orderdate")).cast("string").alias("unreadable"),
            metadata_timestamp({}, "termination_date", F.col("o_orderdate")).cast("string").alias("absent"),
        ),
        "SELECT o_orderkey, '2024-02-03 04:05:06' AS ended, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS unreadable, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS absent FROM orders",
    ),
    "null_safe_compare": (
        lambda s, d: _surface(s, d).select("id", F.col("x3d_emissive_color").eqNullSafe(F.col("x3d_specular_color")).alias("same")),
        oracle("SELECT id, x3d_emissive_color IS NOT DISTINCT FROM x3d_specular_color AS same FROM surface_datas", "surface_datas"),
    ),
}
