"""Kernels against identities and closed forms, without Spark."""

import numpy as np
import pyarrow as pa

from urbanframe.functions import kernels as K

PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))))


def column(parts):
    inner = pa.array(parts, type=PARTS)
    return pa.StructArray.from_arrays(
        [pa.array([3879] * len(parts), pa.int32()), pa.array(["MultiPolygon"] * len(parts)), inner], names=["srid", "kind", "parts"],
        mask=pa.array([p is None for p in parts]),
    )


def ring(*xy):
    pts = [dict(x=float(x), y=float(y), z=0.0) for x, y in xy]
    return pts + pts[:1]


def rect(x0, y0, x1, y1):
    return [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def star(rng, cx, cy, r, n):
    th = np.sort(rng.random(n)) * 2 * np.pi
    rr = r * (0.4 + rng.random(n))
    return [ring(*[(cx + a * np.cos(b), cy + a * np.sin(b)) for a, b in zip(rr, th)])]


def area(col, op="or"):
    c = K.Coords(col)
    return K.overlay_area([c], op, c.n)


def test_overlay_identities():
    rng = np.random.default_rng(5)
    a = [[star(rng, 0, 0, 5, rng.integers(3, 20))] for _ in range(200)]
    b = [[star(rng, *rng.uniform(-6, 6, 2), 5, rng.integers(3, 20))] for _ in range(200)]
    ca, cb, both = column(a), column(b), column([x + y for x, y in zip(a, b)])
    inter = K.overlay_area([K.Coords(ca), K.Coords(cb)], "and", 200)
    assert np.allclose(area(ca) + area(cb), area(both) + inter)
    assert np.allclose(area(K._intersection_batch(ca, cb)), inter)
    assert np.allclose(area(K._union_batch(both)), area(both))
    d = K.distance(K.Coords(ca), K.Coords(cb))
    assert np.allclose(d, K.distance(K.Coords(cb), K.Coords(ca)))
    assert ((d == 0) == (inter > 0)).all()
    hull = area(K._hull_batch(both))
    assert (hull + 1e-9 >= area(both)).all()


def test_holes_parts_and_nulls():
    donut = [rect(0, 0, 10, 10)[0], rect(2, 2, 8, 8)[0]]
    col = column([[donut], [rect(0, 0, 4, 4), rect(2, 0, 6, 4)], None, []])
    assert area(col).tolist() == [64.0, 24.0, 0.0, 0.0]
    hole = column([[rect(3, 3, 4, 4)], [rect(9, 0, 10, 1)], [rect(0, 0, 1, 1)], [rect(0, 0, 1, 1)]])
    d = K.distance(K.Coords(col), K.Coords(hole))
    assert d[0] == 1.0 and d[1] == 3.0 and np.isnan(d[2]) and np.isnan(d[3])
    inside = column([[rect(1, 1, 1.5, 1.5)], [rect(3, 1, 4, 2)], [rect(0, 0, 1, 1)], [rect(0, 0, 1, 1)]])
    assert K.distance(K.Coords(col), K.Coords(inside))[:2].tolist() == [0.0, 0.0]
    merged = K._union_batch(col)
    assert len(merged[1]["parts"]) == 1 and merged[2].as_py() is None


def test_bow_tie_becomes_two_triangles():
    tie = column([[[ring((0, 0), (4, 4), (4, 0), (0, 4))]]])
    assert np.isclose(area(K._union_batch(tie))[0], 8.0)


def test_blocks_do_not_change_results(monkeypatch):
    rng = np.random.default_rng(7)
    a = column([[star(rng, 0, 0, 9, 60)] for _ in range(20)])
    b = column([[star(rng, 4, 1, 9, 60)] for _ in range(20)])
    whole = K.overlay_area([K.Coords(a), K.Coords(b)], "and", 20)
    far = K.distance(K.Coords(a), K.Coords(b))
    monkeypatch.setattr(K, "BLOCK", 500)
    monkeypatch.setattr(K._row_blocks, "__defaults__", (500,))
    monkeypatch.setattr(K._split, "__defaults__", (500,))
    assert np.allclose(whole, K.overlay_area([K.Coords(a), K.Coords(b)], "and", 20))
    assert np.allclose(far, K.distance(K.Coords(a), K.Coords(b)))


def test_hull_paths_agree():
    rng = np.random.default_rng(9)
    for n in (3, 10, 20, 60, 200):
        pts = rng.integers(0, 12, (n, 2))
        col = column([[[ring(*map(tuple, pts))]]])
        ref = K._hull(pts[:, 0].astype(float), pts[:, 1].astype(float))
        got = K._hull_batch(col)[0]["parts"].as_py()[0][0]
        x, y = np.array([p["x"] for p in got]), np.array([p["y"] for p in got])
        shoelace = lambda u, v: abs(np.sum(u[:-1] * v[1:] - u[1:] * v[:-1])) / 2
        assert np.isclose(shoelace(x, y), shoelace(ref[:, 0], ref[:, 1]))


def test_interior_point_is_inside():
    rng = np.random.default_rng(11)
    stars = [[star(rng, 0, 0, 5, 12)] for _ in range(50)]
    pts = K._interior_batch(column(stars))
    dots = column([[[[p.as_py()["parts"][0][0][0]]]] for p in pts])
    assert (K.distance(K.Coords(dots), K.Coords(column(stars))) == 0).all()
