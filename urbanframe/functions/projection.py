"""Transverse Mercator between EPSG:4326 (lon, lat) and EPSG:3879 (E, N).

Krueger series on the GRS80 ellipsoid, written as column expressions. WGS84 and
ETRS89 are taken as equal. Other CRS pairs raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanframe.functions.geometry import _c, geometry, make_point, map_points
from urbanframe.schema import METRIC, WGS84

# Projection parameters (fixed by EPSG:3879 and GRS80).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
CENTRAL_MERIDIAN = 25.0
SCALE = 1.0
FALSE_EASTING = 25500000.0

_N = FLATTENING / (2 - FLATTENING)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
_RECT = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger coefficients to third order (forward, inverse) and latitude series.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)


def _to_metric(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, start=1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EASTING + SCALE * _RECT * east, SCALE * _RECT * north


def _to_degrees(east: Column, north: Column) -> tuple[Column, Column]:
    xi = north / (SCALE * _RECT)
    eta = (east - FALSE_EASTING) / (SCALE * _RECT)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lam = F.atan2(F.sinh(ep), F.cos(xp))
    # Isometric latitude to geodetic latitude by fixed-point steps.
    psi = F.atanh(F.sin(chi))
    phi = chi
    for _ in range(4):
        phi = F.asin(F.tanh(psi + _ECC * F.atanh(_ECC * F.sin(phi))))
    return F.degrees(lam) + CENTRAL_MERIDIAN, F.degrees(phi)


def st_transform(g, target: int) -> Column:
    """Reproject between the two supported CRSs by the srid of each row."""
    if target not in (METRIC, WGS84):
        raise ValueError(f"unsupported target CRS {target}")
    g = _c(g)
    forward = target == METRIC

    def move(p: Column) -> Column:
        x, y = (_to_metric if forward else _to_degrees)(p["x"], p["y"])
        return make_point(x, y, p["z"])

    moved = map_points(g, move)
    source = WGS84 if forward else METRIC
    return (
        F.when(g["srid"] == target, g)
        .when(g["srid"] == source, geometry(g["kind"], moved["parts"], target))
        .when(g.isNull(), F.lit(None))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported source CRS "), g["srid"].cast("string"))))
    )


def change_srid(g, target: int | None, transform: bool = False) -> Column:
    """Relabel or reproject; a null, zero or equal source or a null target is a no-op."""
    g = _c(g)
    if not target:
        return g
    moved = st_transform(g, target) if transform else geometry(g["kind"], g["parts"], target)
    keep = g.isNull() | g["srid"].isNull() | (g["srid"] == 0) | (g["srid"] == target)
    return F.when(keep, g).otherwise(moved)
