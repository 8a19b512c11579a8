"""Contract of the registered queries and a cross-section against the oracle SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from conftest import SF

SAMPLE = [
    "building_base_extended", "buildings_near_green", "parcel_fos", "parcel_far", "shadow_on_green", "combined_rules", "compliance_report",
    "knn_join", "spatial_intersects_join", "styled_geometries", "delete_features", "terminate_features", "feature_envelope", "city_report",
    "class_property_map", "feature_changelog_batch", "read_citygml", "write_geojson_layer", "wfs_not_disjoint", "st_convexhull",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for n in tables.split():
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def _key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    assert got == exp


def test_oracles_parse(duck):
    for name, sql in entry.oracle_sql().items():
        duck.execute("EXPLAIN " + sql)
        assert name in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "distance_to_green_m" in df.columns


def test_row_counts_of_every_layer(spark, tmp_path):
    """Occupation, density and the buildings near green are counted too, on rows of the test's own."""
    tables = {
        "part": "SELECT i AS p_partkey, 'type ' || i % 3 AS p_type, CAST(1 + i * 7 % 50 AS INTEGER) AS p_size, 'p' || i AS p_name, 'b' || i % 4 AS p_brand FROM range(1, 121) t(i)",
        # columns beyond the 36th and the last ten lie far from the model
        "customer": "SELECT i AS c_custkey FROM range(1, 91) t(i) UNION ALL SELECT i + 5000 FROM range(10) t(i)",
        "supplier": "SELECT i AS s_suppkey FROM range(1, 41) t(i)",
    }
    con = duckdb.connect()
    for n, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{n}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet'")
    rows = [tuple(r) for r in entry.queries()["layer_row_counts"](spark, str(tmp_path)).select("layer", "rows").collect()]
    got = dict(rows)
    assert len(rows) == len(got) == 14
    assert got["urban_building_base"] == got["buildings_clean"] == got["building_height_points"] == got["buildings_near_green"] == 120
    # one row a parcel, also where no building stands; parcels far from the model are in no layer
    assert got["parcel_fos"] == got["parcel_far"] == got["parcels_clean"] == sum(c % 50 <= 36 for c in range(1, 91))
    assert got["building_far_estimate"] == got["building_parcel_intersections"] > 0
    assert 0 < got["high_buildings_near_green"] < got["buildings_near_green"]
    assert got == dict(con.execute(entry.oracle_sql()["layer_row_counts"]).fetchall())
