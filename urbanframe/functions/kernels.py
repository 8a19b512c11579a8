"""Arrow-batched geometry measures for which Spark has no expression.

Each function handles a whole Arrow batch with numpy on flat coordinate arrays.
A batch never holds more rows than one Arrow record batch, and intermediate
edge-by-edge products are cut into blocks of bounded size, so one very detailed
geometry costs time, not memory.

Overlay works by slabs: all edges of a row are cut at every vertex and every
edge crossing in x, so inside one slab no two edges cross. Sorted by y, the
even-odd rule per part gives the covered intervals. Intersection, union and
area are then sums over intervals.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanframe.schema import GEOMETRY_DDL

#: Products of edges held at once, and rows of an Arrow batch a kernel takes at once.
BLOCK, SLICE = 250_000, 1000


# ---------------------------------------------------------------- decoding
class Coords:
    """Flat view of a geometry column: points with ring, part and row offsets."""

    def __init__(self, col):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        parts = col.field("parts") if pa.types.is_struct(col.type) else col
        valid = np.asarray(col.is_valid()) & np.asarray(parts.is_valid())
        n = len(col)
        row_off, part_list = _unnest(parts, valid)
        part_off, ring_list = _unnest(part_list, None)
        ring_off, pts = _unnest(ring_list, None)
        self.n = n
        self.valid = valid
        self.row_off, self.part_off, self.ring_off = row_off, part_off, ring_off
        self.x = np.asarray(pts.field("x"), dtype=np.float64)
        self.y = np.asarray(pts.field("y"), dtype=np.float64)
        self.part_row = np.repeat(np.arange(n), np.diff(row_off))
        self.ring_part = np.repeat(np.arange(len(part_off) - 1), np.diff(part_off))
        self.pt_ring = np.repeat(np.arange(len(ring_off) - 1), np.diff(ring_off))
        self.pt_row = self.part_row[self.ring_part[self.pt_ring]] if len(self.pt_ring) else self.pt_ring

    def edges(self):
        """Edges as (row, part, x1, y1, x2, y2); one-point rings give a point edge."""
        size = np.diff(self.ring_off)
        first = np.ones(len(self.x), dtype=bool)
        last_of_ring = np.zeros(len(self.x), dtype=bool)
        ends = self.ring_off[1:][size > 0] - 1
        last_of_ring[ends] = True
        single = np.zeros(len(self.x), dtype=bool)
        single[self.ring_off[:-1][size == 1]] = True
        start = np.flatnonzero((first & ~last_of_ring) | single)
        stop = np.where(single[start], start, start + 1)
        part = self.ring_part[self.pt_ring[start]]
        return (self.part_row[part], part, self.x[start], self.y[start], self.x[stop], self.y[stop])


def _unnest(arr, valid):
    """Offsets (compacted, nulls as empty) and the child array of a list array."""
    off = np.asarray(arr.offsets, dtype=np.int64)
    size = np.diff(off)
    ok = np.asarray(arr.is_valid())
    if valid is not None:
        ok = ok & valid
    if ok.all():
        child = arr.values.slice(off[0], off[-1] - off[0])
        return off - off[0], child
    size = np.where(ok, size, 0)
    child = arr.filter(pa.array(ok)).flatten()
    return np.concatenate([[0], np.cumsum(size)]), child


def _offsets(keys, n):
    """Start offsets of each key value in a sorted key array."""
    return np.searchsorted(keys, np.arange(n + 1))


def _ragged(na, nb):
    """Index pairs of the per-row products na[i] x nb[i]."""
    total = na * nb
    row = np.repeat(np.arange(len(na)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    w = np.repeat(nb, total)
    return row, k // w, k % w


def _row_blocks(cost, limit=BLOCK):
    """Cut rows into consecutive runs whose summed cost stays near the limit."""
    if not len(cost):
        return
    cum = np.cumsum(cost)
    start = 0
    while start < len(cost):
        base = cum[start - 1] if start else 0
        stop = int(np.searchsorted(cum, base + limit, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


# ---------------------------------------------------------------- distance
def _point_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    ll = dx * dx + dy * dy
    t = np.where(ll > 0, ((px - x1) * dx + (py - y1) * dy) / np.where(ll > 0, ll, 1), 0.0)
    t = np.clip(t, 0.0, 1.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _segment_distance2(a, b):
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    d = np.minimum(
        np.minimum(_point_segment(ax1, ay1, bx1, by1, bx2, by2), _point_segment(ax2, ay2, bx1, by1, bx2, by2)),
        np.minimum(_point_segment(bx1, by1, ax1, ay1, ax2, ay2), _point_segment(bx2, by2, ax1, ay1, ax2, ay2)),
    )
    o1, o2 = _orient(ax1, ay1, ax2, ay2, bx1, by1), _orient(ax1, ay1, ax2, ay2, bx2, by2)
    o3, o4 = _orient(bx1, by1, bx2, by2, ax1, ay1), _orient(bx1, by1, bx2, by2, ax2, ay2)
    return np.where((o1 * o2 < 0) & (o3 * o4 < 0), 0.0, d)


def _any_part_inside(qc, gc):
    """Rows where a part of qc starts inside a polygon part of gc."""
    out = np.zeros(qc.n, dtype=bool)
    rows, parts, x1, y1, x2, y2 = gc.edges()
    e_off = _offsets(rows, gc.n)
    # one vertex per part of q is enough when no edges cross
    first_pt = qc.ring_off[:-1][qc.part_off[:-1][np.diff(qc.part_off) > 0]] if len(qc.x) else np.array([], int)
    first_pt = first_pt[first_pt < len(qc.x)]
    q_row = qc.pt_row[first_pt]
    q_off = _offsets(q_row, qc.n)
    nq, ne = np.diff(q_off), np.diff(e_off)
    for s, t in _row_blocks(nq * ne):
        for qs, qe in _split(nq[s:t], ne[s:t]):
            r, i, j = _ragged(qe - qs, ne[s:t])
            if not len(r):
                continue
            p = first_pt[q_off[s:t][r] + qs[r] + i]
            e = e_off[s:t][r] + j
            px, py = qc.x[p], qc.y[p]
            span = (y1[e] > py) != (y2[e] > py)
            dy = np.where(span, y2[e] - y1[e], 1.0)
            hit = span & (px < (x2[e] - x1[e]) * (py - y1[e]) / dy + x1[e])
            key = p * (gc.part_off.size + 1) + parts[e]
            uniq, inv = np.unique(key, return_inverse=True)
            odd = np.bincount(inv, weights=hit) % 2 == 1
            p_in = (uniq // (gc.part_off.size + 1))[odd]
            out[qc.pt_row[p_in]] = True
    return out


def _split(na, nb, limit=BLOCK):
    """Ranges over the first index so that each block of the product is bounded."""
    if len(na) > 1 or (len(na) and na[0] * nb[0] <= 4 * limit):
        yield np.zeros_like(na), na
        return
    step = max(1, int(limit // max(1, nb[0]))) if len(na) else 1
    for a in range(0, int(na[0]) if len(na) else 0, step):
        yield np.array([a]), np.array([min(a + step, int(na[0]))])


def distance(a: Coords, b: Coords) -> np.ndarray:
    """Minimum distance per row; zero for touching or overlapping, nan for empty."""
    ra, _, *ea = a.edges()
    rb, _, *eb = b.edges()
    oa, ob = _offsets(ra, a.n), _offsets(rb, b.n)
    na, nb = np.diff(oa), np.diff(ob)
    best = np.full(a.n, np.inf)
    for s, t in _row_blocks(na * nb):
        for qs, qe in _split(na[s:t], nb[s:t]):
            r, i, j = _ragged(qe - qs, nb[s:t])
            if not len(r):
                continue
            ia, ib = oa[s:t][r] + qs[r] + i, ob[s:t][r] + j
            d = _segment_distance2([v[ia] for v in ea], [v[ib] for v in eb])
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            rows = s + r[starts]
            best[rows] = np.minimum(best[rows], np.minimum.reduceat(d, starts))
    open_rows = best > 0
    if open_rows.any():
        best[_any_part_inside(a, b) | _any_part_inside(b, a)] = 0.0
    best[(na == 0) | (nb == 0)] = np.nan
    return np.sqrt(best)


# ---------------------------------------------------------------- overlay
def _at(row, x):
    """Sortable key of (row, x): complex numbers compare by real, then imaginary part."""
    return row + 1j * x


def _expand(first, count):
    """Runs first[i], first[i] + 1, ... of length count[i]: (owner index, value)."""
    owner = np.repeat(np.arange(len(count)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return owner, first[owner] + step


def _crossings(row, x1, y1, x2, y2):
    """Proper crossings of edges of the same row: (row, x). Edges are sorted by (row, x1)."""
    none = np.array([], int), np.array([], float)
    if not (y1 != y2).any():
        return none  # horizontal edges never cross properly
    # partners of an edge start right of its start and left of its end
    stop = np.searchsorted(_at(row, x1), _at(row, x2), side="left")
    count = np.maximum(stop - np.arange(len(row)) - 1, 0)
    out = []
    for s, t in _row_blocks(count):
        a, b = _expand(np.arange(s, t) + 1, count[s:t])
        a = a + s
        keep = (np.maximum(y1[a], y2[a]) >= np.minimum(y1[b], y2[b])) & (np.maximum(y1[b], y2[b]) >= np.minimum(y1[a], y2[a]))
        a, b = a[keep], b[keep]
        lo, hi = x1[b], np.minimum(x2[a], x2[b])
        sa = (y2[a] - y1[a]) / (x2[a] - x1[a])
        sb = (y2[b] - y1[b]) / (x2[b] - x1[b])
        dl = (y1[a] + sa * (lo - x1[a])) - (y1[b] + sb * (lo - x1[b]))
        dh = (y1[a] + sa * (hi - x1[a])) - (y1[b] + sb * (hi - x1[b]))
        cut = dl * dh < 0
        x = lo[cut] + (hi[cut] - lo[cut]) * (dl[cut] / (dl[cut] - dh[cut]))
        out.append((row[a[cut]], x))
    if not out:
        return none
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _edge_table(sides):
    """Non-vertical edges of all sides, left to right, sorted by (row, x1)."""
    cols = []
    base = 0
    for k, c in enumerate(sides):
        r, p, x1, y1, x2, y2 = c.edges()
        flip = x1 > x2
        xa, ya = np.where(flip, x2, x1), np.where(flip, y2, y1)
        xb, yb = np.where(flip, x1, x2), np.where(flip, y1, y2)
        keep = xa < xb
        cols.append((r[keep], p[keep] + base, np.full(int(keep.sum()), k), xa[keep], ya[keep], xb[keep], yb[keep]))
        base += len(c.part_off) + c.n
    row, part, side, x1, y1, x2, y2 = (np.concatenate(v) for v in zip(*cols))
    o = np.lexsort((x1, row))
    return row[o], part[o], side[o], x1[o], y1[o], x2[o], y2[o]


def _slab_intervals(sides, op, n):
    """Covered intervals per slab: row, slab, lower and upper edge, their mid heights.

    Also returns the slabs (row, left, right) and the edges. op 'or' keeps what
    any side covers, 'and' what both cover.
    """
    row, part, side, x1, y1, x2, y2 = _edge_table(sides)
    cr, cx = _crossings(row, x1, y1, x2, y2)
    cuts = np.unique(_at(np.concatenate([row, row, cr]), np.concatenate([x1, x2, cx])))
    cut_r, cut_x = cuts.real.astype(np.int64), cuts.imag
    slabs = (cut_r[:-1], cut_x[:-1], cut_x[1:]) if len(cuts) else (cut_r, cut_x, cut_x)
    edges = (x1, y1, x2, y2)
    # an edge spans the slabs between the cuts at its two ends
    lo_slab, hi_slab = np.searchsorted(cuts, _at(row, x1)), np.searchsorted(cuts, _at(row, x2))
    load = np.zeros(len(cuts) + 1, np.int64)
    np.add.at(load, lo_slab, 1)
    np.add.at(load, hi_slab, -1)
    load = np.cumsum(load)[: max(len(cuts) - 1, 0)]
    res = []
    for s, t in _row_blocks(load):
        use = np.flatnonzero((lo_slab < t) & (hi_slab > s))
        first = np.maximum(lo_slab[use], s)
        ed, sl = _expand(first, np.minimum(hi_slab[use], t) - first)
        ed = use[ed]
        if not len(ed):
            continue
        xm = (slabs[1][sl] + slabs[2][sl]) / 2
        ym = y1[ed] + (y2[ed] - y1[ed]) * ((xm - x1[ed]) / (x2[ed] - x1[ed]))
        # enter / leave of each edge within its own part
        o = np.lexsort((ym, part[ed], sl))
        pk, sk = part[ed][o], sl[o]
        fresh = np.r_[True, (pk[1:] != pk[:-1]) | (sk[1:] != sk[:-1])]
        idx = np.arange(len(o))
        rank = idx - np.maximum.accumulate(np.where(fresh, idx, 0))
        delta = np.empty(len(o), int)
        delta[o] = np.where(rank % 2 == 0, 1, -1)
        o = np.lexsort((-delta, ym, sl))
        sl, ed, ym, delta = sl[o], ed[o], ym[o], delta[o]
        cover = np.full(len(sl), op == "and")
        for k in range(len(sides)):
            depth = np.cumsum(np.where(side[ed] == k, delta, 0)) > 0
            cover = (cover & depth) if op == "and" else (cover | depth)
        g = np.flatnonzero(cover[:-1] & (sl[1:] == sl[:-1]) & (ym[1:] > ym[:-1]))
        if len(g):
            # join stacked intervals that share a border inside one slab
            head = np.r_[True, ~((sl[g][1:] == sl[g][:-1]) & (ym[g][1:] == ym[g + 1][:-1]))]
            low, up = g[head], g[np.r_[head[1:], True]] + 1
            res.append((sl[low], ed[low], ed[up], ym[low], ym[up]))
    if not res:
        z = np.array([], int)
        return z, z, z, z, np.array([]), np.array([]), slabs, edges
    sl, low, up, ylo, yup = (np.concatenate(v) for v in zip(*res))
    return slabs[0][sl], sl, low, up, ylo, yup, slabs, edges


def overlay_area(sides, op, n) -> np.ndarray:
    row, sl, _, _, ylo, yup, (_, left, right), _ = _slab_intervals(sides, op, n)
    if not len(row):
        return np.zeros(n)
    return np.bincount(row, weights=(right[sl] - left[sl]) * (yup - ylo), minlength=n)


def overlay_parts(sides, op, n):
    """Covered area as trapezoids, joined across slabs that share both borders."""
    row, sl, lo, up, _, _, (_, left, right), (x1, y1, x2, y2) = _slab_intervals(sides, op, n)

    def line_key(e):
        slope = (y2[e] - y1[e]) / (x2[e] - x1[e])
        return np.round(slope, 9), np.round(y1[e] - slope * x1[e], 6)

    if len(row):
        ls, lc = line_key(lo)
        us, uc = line_key(up)
        o = np.lexsort((sl, uc, us, lc, ls, row))
        row, sl, lo, up = row[o], sl[o], lo[o], up[o]
        ls, lc, us, uc = ls[o], lc[o], us[o], uc[o]
        same = (
            (row[1:] == row[:-1]) & (ls[1:] == ls[:-1]) & (lc[1:] == lc[:-1])
            & (us[1:] == us[:-1]) & (uc[1:] == uc[:-1]) & (left[sl][1:] == right[sl][:-1])
        )
        first = np.r_[True, ~same]
        last = np.r_[~same, True]
        xl, xr = left[sl[first]], right[sl[last]]
        lo_f, up_f, lo_l, up_l = lo[first], up[first], lo[last], up[last]
        row = row[first]

        def at(e, x):
            return y1[e] + (y2[e] - y1[e]) * ((x - x1[e]) / (x2[e] - x1[e]))

        px = np.stack([xl, xr, xr, xl, xl], axis=1)
        py = np.stack([at(lo_f, xl), at(lo_l, xr), at(up_l, xr), at(up_f, xl), at(lo_f, xl)], axis=1)
    else:
        px = py = np.zeros((0, 5))
    return row, px, py


def _parts_array(row, px, py, n, valid):
    """Nested Arrow lists: one five-point ring per part."""
    o = np.argsort(row, kind="stable")
    px, py = px[o].ravel(), py[o].ravel()
    pts = pa.StructArray.from_arrays([pa.array(px), pa.array(py), pa.array(np.zeros(len(px)))], names=["x", "y", "z"])
    m = len(row)
    rings = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * 5, pa.int32()), pts)
    parts = pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), rings)
    off = _offsets(row[o], n).astype(np.int32)
    mask = np.r_[~valid, False]
    return pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=mask), parts)


def _geometry(source, kind, parts, valid):
    """Geometry column with the srid of the source column."""
    if isinstance(source, pa.ChunkedArray):
        source = source.combine_chunks()
    kinds = pa.array([kind] * len(parts), pa.string())
    return pa.StructArray.from_arrays(
        [source.field("srid"), kinds, parts], names=["srid", "kind", "parts"], mask=pa.array(~valid)
    )


# ---------------------------------------------------------------- convex hull
def _hull(x, y):
    """Counter-clockwise hull (monotone chain) of one point set, closed."""
    pts = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(pts) < 3:
        return np.vstack([pts, pts[:1]])

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and _orient(*out[-2], *out[-1], *p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(pts) + chain(pts[::-1])
    return np.array(ring + ring[:1])


def hull_parts(c: Coords):
    """Hulls of all rows: small rows by gift wrapping in lockstep, others one by one."""
    cnt = np.diff(_offsets(c.pt_row, c.n))
    off = _offsets(c.pt_row, c.n)
    rings = [np.zeros((0, 2))] * c.n
    small = np.flatnonzero((cnt > 0) & (cnt <= 64))
    for width in (12, 24, 64):
        sel = small[(cnt[small] <= width) & (cnt[small] > (0 if width == 12 else width // 2 if width == 24 else 24))]
        if len(sel):
            for r, ring in zip(sel, _wrap(c, sel, off, cnt, width)):
                rings[r] = ring
    for r in np.flatnonzero(cnt > 64):
        rings[r] = _hull(c.x[off[r]:off[r + 1]], c.y[off[r]:off[r + 1]])
    return rings


def _wrap(c, sel, off, cnt, width):
    idx = off[sel][:, None] + np.minimum(np.arange(width)[None, :], cnt[sel][:, None] - 1)
    X, Y = c.x[idx], c.y[idx]
    k = len(sel)
    rows = np.arange(k)
    start = np.lexsort((Y.T, X.T), axis=0)[0] if width else None
    cur = start.copy()
    path = [start]
    done = np.zeros(k, dtype=bool)
    for _ in range(width):
        nxt = np.where(cur == 0, 1 if width > 1 else 0, 0)
        for j in range(width):
            cx, cy = X[rows, cur], Y[rows, cur]
            bx, by, jx, jy = X[rows, nxt], Y[rows, nxt], X[:, j], Y[:, j]
            turn = _orient(cx, cy, bx, by, jx, jy)
            far = (jx - cx) ** 2 + (jy - cy) ** 2 > (bx - cx) ** 2 + (by - cy) ** 2
            nxt = np.where((turn < 0) | ((turn == 0) & far), j, nxt)
        back = (X[rows, nxt] == X[rows, start]) & (Y[rows, nxt] == Y[rows, start])
        cur = np.where(done, cur, nxt)
        path.append(np.where(done | back, start, cur))
        done |= back
        if done.all():
            break
    P = np.stack(path, axis=1)
    length = np.argmax(P[:, 1:] == start[:, None], axis=1) + 2
    return [np.stack([X[r, P[r, :m]], Y[r, P[r, :m]]], axis=1) for r, m in zip(rows, length)]


# ---------------------------------------------------------------- Spark functions
def _in_slices(batch):
    """The kernel on at most ``SLICE`` rows at once: its products take the memory of a slice, not of a whole Arrow batch."""

    @functools.wraps(batch)
    def sliced(*cols):
        starts = range(0, len(cols[0]), SLICE)
        return batch(*cols) if len(starts) < 2 else pa.concat_arrays([batch(*(c.slice(i, SLICE) for c in cols)) for i in starts])

    return sliced


@_in_slices
def _distance_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    d = distance(Coords(a), Coords(b))
    return pa.array(d, mask=np.isnan(d))


@_in_slices
def _intersection_area_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    ca, cb = Coords(a), Coords(b)
    return pa.array(overlay_area([ca, cb], "and", ca.n), mask=~(ca.valid & cb.valid))


@_in_slices
def _covered_area_batch(a: pa.Array) -> pa.Array:
    c = Coords(a)
    return pa.array(overlay_area([c], "or", c.n), mask=~c.valid)


@_in_slices
def _intersection_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    ca, cb = Coords(a), Coords(b)
    ok = ca.valid & cb.valid
    return _geometry(a, "MultiPolygon", _parts_array(*overlay_parts([ca, cb], "and", ca.n), ca.n, ok), ok)


@_in_slices
def _union_batch(a: pa.Array) -> pa.Array:
    c = Coords(a)
    return _geometry(a, "MultiPolygon", _parts_array(*overlay_parts([c], "or", c.n), c.n, c.valid), c.valid)


@_in_slices
def _hull_batch(a: pa.Array) -> pa.Array:
    c = Coords(a)
    rings = hull_parts(c)
    size = np.array([len(r) for r in rings], dtype=np.int64)
    flat = np.concatenate(rings) if len(rings) else np.zeros((0, 2))
    pts = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(np.zeros(len(flat)))], names=["x", "y", "z"]
    )
    full = size > 0
    ring_off = np.concatenate([[0], np.cumsum(size[full])]).astype(np.int32)
    ring = pa.ListArray.from_arrays(pa.array(ring_off, pa.int32()), pts)
    m = int(full.sum())
    part = pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), ring)
    off = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
    parts = pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=np.r_[~c.valid, False]), part)
    return _geometry(a, "Polygon", parts, c.valid)


@_in_slices
def _interior_batch(a: pa.Array) -> pa.Array:
    c = Coords(a)
    row, sl, _, _, ylo, yup, (_, left, right), _ = _slab_intervals([c], "or", c.n)
    x, y = np.full(c.n, np.nan), np.full(c.n, np.nan)
    size = (right[sl] - left[sl]) * (yup - ylo)
    o = np.lexsort((size, row))
    x[row[o]], y[row[o]] = ((left[sl] + right[sl]) / 2)[o], ((ylo + yup) / 2)[o]
    # lines and points have no interior: take the first vertex
    bare = np.flatnonzero(np.isnan(x) & (np.diff(_offsets(c.pt_row, c.n)) > 0))
    first = _offsets(c.pt_row, c.n)[bare]
    x[bare], y[bare] = c.x[first], c.y[first]
    found = ~np.isnan(x)
    pts = pa.StructArray.from_arrays([pa.array(x[found]), pa.array(y[found]), pa.array(np.zeros(int(found.sum())))], names=["x", "y", "z"])
    m = pa.array(np.arange(int(found.sum()) + 1), pa.int32())
    off = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
    parts = pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=np.r_[~found, False]), pa.ListArray.from_arrays(m, pa.ListArray.from_arrays(m, pts)))
    return _geometry(a, "Point", parts, found)


def _run(batch, ddl: str, *cols) -> Column:
    # Built per use: a function object is bound to the session that made it.
    # Marked so that Spark never copies the call into a filter it pushes down,
    # which would run the kernel twice and before the rows are spread.
    return F.arrow_udf(batch, ddl).asNondeterministic()(*cols)


def _c(g):
    return F.col(g) if isinstance(g, str) else g


def st_distance(a, b) -> Column:
    return _run(_distance_batch, "double", _c(a), _c(b))


def st_dwithin(a, b, r) -> Column:
    return st_distance(a, b) <= (r if isinstance(r, Column) else F.lit(float(r)))


def st_intersects(a, b) -> Column:
    return st_distance(a, b) == 0.0


def st_intersection_area(a, b) -> Column:
    return _run(_intersection_area_batch, "double", _c(a), _c(b))


def st_covered_area(g) -> Column:
    """Area of the union of all parts (overlaps counted once)."""
    return _run(_covered_area_batch, "double", _c(g))


def st_intersection(a, b) -> Column:
    return _run(_intersection_batch, GEOMETRY_DDL, _c(a), _c(b))


def st_unaryunion(g) -> Column:
    return _run(_union_batch, GEOMETRY_DDL, _c(g))


def st_makevalid(g) -> Column:
    """Non-overlapping polygons that cover the same area (even-odd inside a part)."""
    return _run(_union_batch, GEOMETRY_DDL, _c(g))


def st_convexhull(g) -> Column:
    return _run(_hull_batch, GEOMETRY_DDL, _c(g))


def st_pointonsurface(g) -> Column:
    return _run(_interior_batch, GEOMETRY_DDL, _c(g))
