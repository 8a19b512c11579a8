"""Feature requests, edits and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import height_category
from urbanframe.operators import features as op
from urbanframe.registry import city
from urbanframe.registry.city import oracle, table

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_SQL = ", ".join(CUST)


def _customer(s, d):
    return table(s, d, "customer").withColumnRenamed("c_custkey", "id")


def _b(s, d):
    return city.relation(s, d, "buildings").select(
        F.col("k").alias("id"), "height_m", height_category(F.col("height_m")).alias("height_category"), "p_type"
    )


def _parcel_query(**kw):
    return lambda s, d: op.query_features(city.parcels(s, d), columns=["id"], **kw)


def _colour(col, mapping, default):
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


def _triangle():
    pts = [(105.0, 95.0), (400.0, 160.0), (150.0, 500.0), (105.0, 95.0)]
    return G.st_makepolygon(F.array(*[G.make_point(x, y) for x, y in pts]))


# A convex query polygon meets a rectangle unless one of the triangle's edges, or a side of the rectangle,
# separates them.
def _separated(edges):
    tests = []
    for (ax, ay), (bx, by) in edges:
        corner = [f"(({bx} - {ax}) * (y{j} - {ay}) - ({by} - {ay}) * (x{i} - {ax}) < 0)" for i in (0, 1) for j in (0, 1)]
        tests.append("(" + " AND ".join(corner) + ")")
    return " OR ".join(tests)


_T = [(105, 95), (400, 160), (150, 500)]
NOT_DISJOINT = (
    f"NOT ({_separated(list(zip(_T, _T[1:] + _T[:1])))} OR x1 < 105 OR x0 > 400 OR y1 < 95 OR y0 > 500)"
)

ENTRIES = {
    "wfs_fid": (
        lambda s, d: op.query_features(_customer(s, d), fids=[3, 14, 77]),
        "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (3, 14, 77)",
    ),
    "wfs_property_equals": (
        lambda s, d: op.query_features(_customer(s, d), where=F.col("c_mktsegment") == "BUILDING"),
        "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "wfs_projection": (
        lambda s, d: op.query_features(_customer(s, d), columns=["id", "c_name"]),
        "SELECT c_custkey AS id, c_name FROM customer",
    ),
    "wfs_bbox": (
        _parcel_query(bbox=(100, 60, 520, 333)),
        oracle("SELECT id FROM parcels WHERE x1 >= 100 AND x0 <= 520 AND y1 >= 60 AND y0 <= 333", "parcels"),
    ),
    "wfs_between": (
        lambda s, d: op.query_features(_customer(s, d), where="c_acctbal BETWEEN 1000 AND 2500.5", columns=["id", "c_acctbal"]),
        "SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500.5",
    ),
    "wfs_intersects_point": (
        _parcel_query(point=(70.0, 60.0)),
        oracle("SELECT id FROM parcels WHERE 70 BETWEEN x0 AND x1 AND 60 BETWEEN y0 AND y1", "parcels"),
    ),
    "wfs_not_disjoint": (
        lambda s, d: op.query_features(city.parcels(s, d), columns=["id"], not_disjoint=_triangle()),
        oracle(f"SELECT id FROM parcels WHERE {NOT_DISJOINT}", "parcels"),
    ),
    "wfs_math_filter": (
        lambda s, d: op.query_features(
            table(s, d, "part").withColumnRenamed("p_partkey", "id"), columns=["id", "p_size"],
            where=F.col("p_size") / F.nullif(F.col("p_retailprice"), F.lit(0.0)) > 0.025,
        ),
        "SELECT p_partkey AS id, p_size FROM part WHERE p_size / nullif(p_retailprice, 0) > 0.025",
    ),
    "wfs_multi_layer": (
        lambda s, d: op.query_layers({
            "customers": (_customer(s, d).select("id", "c_name", "c_acctbal"), F.col("c_acctbal") > 5000),
            "suppliers": (table(s, d, "supplier").selectExpr("s_suppkey AS id", "s_name"), F.col("id") < 50),
        }),
        "SELECT c_custkey AS id, c_name, c_acctbal, 'customers' AS layer, NULL AS s_name FROM customer WHERE c_acctbal > 5000 "
        "UNION ALL SELECT s_suppkey, NULL, NULL, 'suppliers', s_name FROM supplier WHERE s_suppkey < 50",
    ),
    "wfs_max_features": (
        lambda s, d: op.query_features(_customer(s, d), columns=["id", "c_name"], limit=100),
        "SELECT c_custkey AS id, c_name FROM customer ORDER BY c_custkey LIMIT 100",
    ),
    "wfs_logic": (
        lambda s, d: op.query_features(
            _customer(s, d), columns=["id"],
            where=((F.col("c_nationkey") < 3) & (F.col("c_mktsegment") == "MACHINERY")) | (100 - F.col("c_nationkey") > 95) & (F.col("c_acctbal") > 2000),
        ),
        "SELECT c_custkey AS id FROM customer WHERE (c_nationkey < 3 AND c_mktsegment = 'MACHINERY') OR (100 - c_nationkey > 95 AND c_acctbal > 2000)",
    ),
    "wfs_insert": (
        lambda s, d: op.insert_features(
            _customer(s, d).select("id", "c_name"),
            table(s, d, "supplier").select((F.col("s_suppkey") + 10**6).alias("id"), F.col("s_name").alias("c_name")),
        ),
        "SELECT c_custkey AS id, c_name FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier",
    ),
    "wfs_update": (
        lambda s, d: op.update_features(
            _customer(s, d).select("id", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT"), "c_acctbal": F.lit(0.0)}
        ),
        "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, "
        "CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    ),
    "wfs_delete": (
        lambda s, d: op.delete_features_where(_customer(s, d).select("id", "c_mktsegment"), F.col("c_mktsegment") == "HOUSEHOLD"),
        "SELECT c_custkey AS id, c_mktsegment FROM customer WHERE NOT coalesce(c_mktsegment = 'HOUSEHOLD', false)",
    ),
    "style_rules": (
        lambda s, d: op.style_heights(_b(s, d)).select("id", "height_category", "style"),
        oracle(
            "WITH c AS (SELECT k AS id, CASE WHEN height_m >= 40 THEN 'muy_alto' WHEN height_m >= 25 THEN 'alto' WHEN height_m >= 12 THEN 'medio' ELSE 'bajo' END AS height_category FROM buildings) "
            f"SELECT id, height_category, {_colour('height_category', op.HEIGHT_COLOURS, op.HEIGHT_ELSE)} AS style FROM c", "buildings",
        ),
    ),
    "style_recode": (
        lambda s, d: table(s, d, "customer").select(
            F.col("c_custkey").alias("id"), op.recode(F.col("c_nationkey") % 10, op.MAP_COLOURS).alias("colour"),
            F.when(F.col("c_mktsegment") == "BUILDING", 7).otherwise(5).alias("size"),
        ),
        "SELECT c_custkey AS id, CASE c_nationkey % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in op.MAP_COLOURS.items())
        + " END AS colour, CASE WHEN c_mktsegment = 'BUILDING' THEN 7 ELSE 5 END AS size FROM customer",
    ),
}
