"""Grid joins against brute force, on sizes from points to very large boxes and on dense spots."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.operators import spatial_join as S


def _rows(n=300, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        s = random.choice([1, 5, 20, 200, 3000]) if i % 7 == 0 else random.choice([0, 1, 5, 10])
        # a third of all rows in one spot, some of them exact copies
        x, y = (100.0, 100.0) if i % 9 == 0 else (random.gauss(100, 8), random.gauss(100, 8)) if i % 3 == 0 else (
            random.uniform(-2000, 2000), random.uniform(-2000, 2000))
        w, h = (3.0, 3.0) if i % 9 == 0 else (random.random() * s, random.random() * s)
        rows.append((i, x, y, x + w, y + h))
    return rows


def _dist(a, b):
    return math.hypot(max(0, a[1] - b[3], b[1] - a[3]), max(0, a[2] - b[4], b[2] - a[4]))


@pytest.fixture(scope="module")
def data(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long,x0 double,y0 double,x1 double,y1 double")
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    left = df.select("id", G.st_rectangle(*c).alias("geom"), G.bbox_struct(*c).alias("bbox"))
    right = left.select(F.col("id").alias("rid"), F.col("geom").alias("rgeom"), F.col("bbox").alias("rbox"))
    return rows, left, right


def test_intersects_pairs_once(data):
    rows, left, right = data
    got = [tuple(r) for r in S.join_intersects(left, right, "geom", "rgeom", "bbox", "rbox").select("id", "rid").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a[0], b[0]) for a in rows for b in rows if _dist(a, b) == 0}


def test_pairs_within(data):
    rows, left, _ = data
    got = [tuple(r) for r in S.pairs_within(left, "id", "geom", "bbox", 6.0).select("a_id", "b_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _dist(a, b) <= 6}


def test_dwithin_join(data):
    rows, left, right = data
    got = S.join_dwithin(left, right, "geom", "rgeom", "bbox", "rbox", 50.0).select("id", "rid", "distance_m").collect()
    exp = {(a[0], b[0]): _dist(a, b) for a in rows for b in rows if _dist(a, b) <= 50}
    assert {(r[0], r[1]) for r in got} == set(exp)
    assert all(abs(r[2] - exp[r[0], r[1]]) < 1e-9 for r in got)


@pytest.mark.parametrize("other_only", [True, False])
def test_nearest(data, other_only):
    rows, left, right = data
    got = {r[0]: (r[1], r[2]) for r in S.nearest(left, right.where("rid >= 40"), "id", "rid", "geom", "rgeom", "bbox", "rbox", other_only=other_only).collect()}
    assert len(got) == len(rows)
    for a in rows:
        d, i = min((_dist(a, b), b[0]) for b in rows if b[0] >= 40 and not (other_only and a[0] == b[0]))
        assert abs(got[a[0]][1] - d) < 1e-9
        if d == 0:
            assert got[a[0]][0] == i


def test_nearest_of_single_row_is_absent(data):
    _, left, right = data
    one = left.where("id = 5")
    assert S.nearest(one, right.where("rid = 5"), "id", "rid", "geom", "rgeom", "bbox", "rbox", other_only=True).count() == 0


def test_semi_dwithin(data):
    rows, left, _ = data
    pts = left.select(G.st_x("geom").alias("x"), G.st_y("geom").alias("y")).where("x > 0 and y < -500")
    xy = [(r.x, r.y) for r in pts.collect()]
    got = [r[0] for r in S.semi_dwithin_points(left, "id", "geom", "bbox", pts, "x", "y", 150.0).select("id").collect()]
    exp = {a[0] for a in rows if any(_dist(a, (0, x, y, x, y)) <= 150 for x, y in xy)}
    assert len(got) == len(set(got)) and set(got) == exp


def test_plan_is_an_equi_join(data):
    _, left, right = data
    plan = S.bbox_join(left, right, "bbox", "rbox").select("id", "rid")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_kernel_runs_once_per_pair(data):
    _, left, right = data
    plan = S.join_dwithin(left, right, "geom", "rgeom", "bbox", "rbox", 5.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_column_clash_is_refused(data):
    _, left, _ = data
    with pytest.raises(ValueError):
        S.bbox_join(left, left, "bbox", "bbox")


def _boxes(spark, rows):
    df = spark.createDataFrame(rows, "id long,x0 double,y0 double,x1 double,y1 double")
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    return df.select("id", G.st_rectangle(*c).alias("geom"), G.bbox_struct(*c).alias("bbox"))


def _polygon(spark, rings):
    rows = [(1, [[[(float(x), float(y), 0.0) for x, y in [*r, r[0]]] for r in rings]])]
    df = spark.createDataFrame(rows, "pid long, parts array<array<array<struct<x: double, y: double, z: double>>>>")
    df = df.select("pid", G.geometry("Polygon", F.col("parts"), 3879).alias("pgeom"))
    return df.withColumn("pbox", G.st_bbox("pgeom"))


def _large(spark):
    """An L-shaped polygon of 30 km with a hole, and 20,000 footprints around it, a third of them in one place."""
    rnd = random.Random(2)
    ring = [(0, 0), (30_000, 0), (30_000, 12_000), (12_000, 12_000), (12_000, 30_000), (0, 30_000)]
    hole = [(2_000, 2_000), (2_000, 9_000), (9_000, 9_000), (9_000, 2_000)]
    rows = []
    for i in range(20_000):
        x, y = (rnd.uniform(500, 800), rnd.uniform(500, 800)) if i % 3 == 0 else (rnd.uniform(-3000, 33_000), rnd.uniform(-3000, 33_000))
        if i % 500 == 1:  # on the border
            x, y = rnd.choice([(12_000 - 4, 15_000 + i), (30_000, 7.0 + i / 10), (9_000 - 5, 4_000 + i / 10), (-10, 100.0 + i)])
        rows.append((i, float(x), float(y), x + 10.0, y + rnd.uniform(1, 10)))
    return _polygon(spark, [ring, hole]), _boxes(spark, rows), rows


def test_large_polygon_against_footprints(spark):
    poly, foot, rows = _large(spark)
    got = [r[0] for r in S.join_intersects(foot, poly, "geom", "pgeom", "bbox", "pbox").select("id").collect()]
    assert len(got) == len(set(got))

    def expected(x0, y0, x1, y1):
        legs = [(0, 0, 30_000, 12_000), (0, 0, 12_000, 30_000)]
        meets = any(x0 <= c and x1 >= a and y0 <= d and y1 >= b for a, b, c, d in legs)
        inside_hole = x0 > 2_000 and x1 < 9_000 and y0 > 2_000 and y1 < 9_000
        return meets and not inside_hole

    assert set(got) == {i for i, *b in rows if expected(*b)}


def test_large_polygon_is_cut_into_cells(spark):
    poly, foot, rows = _large(spark)
    a, b = S._own_cells(S._edged(foot, "bbox", "a"), "a"), S._own_cells(S._edged(poly, "pbox", "b"), "b")
    levels = S._present(foot, "bbox"), S._present(poly, "pbox")
    assert levels[1][0] - levels[0][-1] >= 3
    down = S._walk_down(b, "b", levels[1], S._occupied(a, "a", levels[0], levels[1][-1] - 1), levels[0], "pgeom")
    # a cell of the join holds few footprints, and each occupied cell meets the polygon once
    assert a.groupBy("_a_l", "_a_cx", "_a_cy").count().agg(F.max("count")).first()[0] <= 300
    assert all(d.groupBy("_b_cx", "_b_cy").count().where("count > 1").isEmpty() for d in down)
    pairs = S.bbox_join(foot, poly, "bbox", "pbox", "geom", "pgeom")
    inner, all_ = pairs.where("_inner").count(), pairs.count()
    assert inner > 0.5 * all_  # most answers need no exact test


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_levels_against_brute_force(spark, seed):
    rnd = random.Random(seed)

    def rows(n, sizes):
        out = []
        for i in range(n):
            x, y, s = rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice(sizes)
            out.append((i, x, y, x + rnd.random() * s, y + rnd.random() * s))
        return out + [(n, 8.0, 8.0, 64.0, 64.0), (n + 1, -64.0, 0.0, 0.0, 0.0), (n + 2, 0.0, 0.0, 0.0, 0.0)]

    left, right = rows(120, [0, 0.3, 40, 900]), rows(120, [5, 5000])
    l, r = _boxes(spark, left), _boxes(spark, right).select(F.col("id").alias("rid"), F.col("geom").alias("rgeom"), F.col("bbox").alias("rbox"))
    for a, b, ka, kb in ((l, r, "id", "rid"), (r, l, "rid", "id")):
        ga, gb, ba, bb = ("geom", "rgeom", "bbox", "rbox") if ka == "id" else ("rgeom", "geom", "rbox", "bbox")
        got = [(x["id"], x["rid"]) for x in S.join_intersects(a, b, ga, gb, ba, bb).select("id", "rid").collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(p[0], q[0]) for p in left for q in right if _dist(p, q) == 0}


def test_join_with_nothing(spark):
    l = _boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    r = l.select(F.col("id").alias("rid"), F.col("geom").alias("rgeom"), F.col("bbox").alias("rbox"))
    assert S.join_intersects(l, r.where("rid > 1"), "geom", "rgeom", "bbox", "rbox").count() == 0
    assert S.nearest(l, r.where("rid > 1"), "id", "rid", "geom", "rgeom", "bbox", "rbox").count() == 0


def _anchored(spark, rows):
    flat = [(i, x, y, x + 5, y + 5, x, y) for i, x, y in rows]
    return S.cut_lineage(spark.createDataFrame(flat, "id long,x0 double,y0 double,x1 double,y1 double,ax double,ay double"))


@pytest.mark.parametrize("place", ["far", "hot", "line"])
def test_candidates_in_proportion_to_rows(spark, place):
    rnd = random.Random(7)
    cloud = lambda n, x, y, s: [(x + rnd.random() * s, y + rnd.random() * s) for _ in range(n)]
    left = cloud(2000, 0, 0, 1000)
    right = {
        "far": cloud(2000, 100_000, 20_000, 1000),  # 100 km away
        "hot": cloud(1000, 500, 500, 40) + cloud(1000, 0, 0, 50_000),  # half of all in one spot
        "line": [(-5_000.0, i * 10.0) for i in range(2000)],
    }[place]
    a, b = [(i, x, y) for i, (x, y) in enumerate(left)], [(i, x, y) for i, (x, y) in enumerate(right)]
    pairs = {}
    for r in S.nearest_candidates(_anchored(spark, a), _anchored(spark, b)).collect():
        pairs.setdefault(r["lk"], []).append(r["rk"])
    # in the spot sixteen boxes lie over each other, which no bound on boxes can tell apart
    assert len(pairs) == len(a) and sum(map(len, pairs.values())) <= (40 if place == "hot" else 10) * len(a)
    for i, x, y in rnd.sample(a, 50):
        gap = lambda j: max(abs(right[j][0] - x) - 5, 0) ** 2 + max(abs(right[j][1] - y) - 5, 0) ** 2  # noqa: B023, E731
        assert math.isclose(min(map(gap, pairs[i])), min(map(gap, range(len(right)))), rel_tol=1e-9, abs_tol=1e-6)


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_meet_without_broadcast(spark):
    from urbanframe.operators.footprints import footprint_chain
    from urbanframe.registry import city
    from urbanframe.session import cut_lineage

    from conftest import SF

    x = F.col("id").cast("double")
    rows = cut_lineage(spark.range(300).select("id", G.bbox_struct(x, x, x + 1.5, x + 1.5).alias("bbox"), F.lit("w" * 50).alias("wide")))
    pairs = S.bbox_join(rows.select("id", "bbox"), rows.select(F.col("id").alias("other"), F.col("bbox").alias("obox")), "bbox", "obox")
    assert "Broadcast" not in _planned(pairs)
    assert sorted((p.id, p.other) for p in pairs.collect()) == [(a, b) for a in range(300) for b in (a - 1, a, a + 1) if 0 <= b < 300]
    store = city.store(spark, SF)
    chain = footprint_chain(store["feature"], store["property"], store["objectclass"], store["geometry_data"])
    # the dictionary of classes may be broadcast, rows of the store are not
    assert not [j for j in _planned(chain).split("\n") if "BroadcastHashJoin" in j and "Inner" in j]


def test_candidate_pairs_of_nearest_rows_are_not_shuffled(spark):
    from urbanframe.session import cut_lineage

    n = 2000
    at = spark.range(n).select("id", ((F.col("id") * 7919) % 1009).cast("double").alias("ax"), ((F.col("id") * 104729) % 997).cast("double").alias("ay"))
    rows = cut_lineage(at.select("id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), "ax", "ay"))
    got = S.nearest_candidates(rows, rows, True)
    assert "Window" not in _planned(got)
    found = {(p.lk, p.rk) for p in got.collect()}
    pts = {r.id: (r.ax, r.ay) for r in rows.collect()}
    for a in range(0, n, 50):
        far = {b: math.dist(pts[a], pts[b]) for b in pts if b != a}
        assert {(a, b) for b, d in far.items() if d == min(far.values())} <= found
    assert len(found) < 8 * n
