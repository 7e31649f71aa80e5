"""Geodesy: degrees to local metres on the WGS84 ellipsoid (polyconic about a reference) and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84, and the series for the meridian distance (coefficients of sin**k in powers of the squared eccentricity).
EQUATOR_M = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = 2.0 * FLATTENING - FLATTENING * FLATTENING
SERIES = (
    (1.0, -0.25, -0.046875, -0.01953125, -0.01068115234375),
    (0.0, 0.75, -0.046875, -0.01953125, -0.01068115234375),
    (0.0, 0.0, 0.46875, -0.01302083333333333333, -0.00712076822916666666),
    (0.0, 0.0, 0.0, 0.36458333333333333333, -0.00569661458333333333),
    (0.0, 0.0, 0.0, 0.0, 0.3076171875),
)
M = tuple(sum(c * E2**k for k, c in enumerate(row)) for row in SERIES)


def _meridian(lat, sin, cos):
    s = sin(lat)
    s2 = s * s
    return M[0] * lat - s * cos(lat) * (M[1] + s2 * (M[2] + s2 * (M[3] + s2 * M[4])))


def to_cartesian(ref_lat: Column, ref_lon: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) in metres of a point about a reference, all in degrees.  Beyond a pole, or beyond 10 radians of longitude, (0, 0)."""
    rad = lambda c: c * F.lit(float(np.pi / 180))
    p0, l0, p, lo = rad(ref_lat), rad(ref_lon), rad(lat), rad(lon)
    m0 = _meridian(p0, F.sin, F.cos)
    s = F.sin(p)
    flat = F.abs(p) < 1e-10
    nu = F.when(F.abs(s) > 1e-10, F.cos(p) / F.sqrt(1 - E2 * s * s) / F.when(flat, F.lit(1.0)).otherwise(s)).otherwise(0.0)
    a = (lo - l0) * s
    east = F.when(flat, lo - l0).otherwise(nu * F.sin(a))
    north = F.when(flat, -m0).otherwise(_meridian(p, F.sin, F.cos) - m0 + nu * (1 - F.cos(a)))
    out = (F.abs(p) - float(np.pi / 2) > 1e-12) | (F.abs(lo) > 10.0)
    return F.when(out, 0.0).otherwise(EQUATOR_M * east), F.when(out, 0.0).otherwise(EQUATOR_M * north)


def to_cartesian_np(ref_lat, ref_lon, lat, lon):
    """to_cartesian for arrays."""
    p0, l0, p, lo = (np.radians(np.asarray(v, float)) for v in (ref_lat, ref_lon, lat, lon))
    s = np.sin(p)
    flat = np.abs(p) < 1e-10
    safe = np.where(np.abs(s) > 1e-10, s, 1.0)
    nu = np.where(np.abs(s) > 1e-10, np.cos(p) / np.sqrt(1 - E2 * s * s) / safe, 0.0)
    m0, a = _meridian(p0, np.sin, np.cos), (lo - l0) * s
    east = np.where(flat, lo - l0, nu * np.sin(a))
    north = np.where(flat, -m0, _meridian(p, np.sin, np.cos) - m0 + nu * (1 - np.cos(a)))
    out = (np.abs(p) - np.pi / 2 > 1e-12) | (np.abs(lo) > 10.0)
    return np.where(out, 0.0, EQUATOR_M * east), np.where(out, 0.0, EQUATOR_M * north)


def from_cartesian_np(ref_lat, ref_lon, east, north):
    """(lat, lon) of local metres: a fixed-point search, latitude first, then longitude.

    A step moves by a millionth of the error in degrees (1e-9 at least) towards the point; a row
    stops when its error no longer falls or is 1e-10 m.
    """
    ref_lat, ref_lon, east, north = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(ref_lat, ref_lon, east, north))
    at = [ref_lat.copy(), ref_lon.copy()]
    for axis, goal in ((0, north), (1, east)):
        way = np.where(goal < 0, -1.0, 1.0)
        error = lambda rows: np.abs(goal[rows] - to_cartesian_np(ref_lat[rows], ref_lon[rows], at[0][rows], at[1][rows])[1 - axis])  # noqa: B023, E731
        rows = np.arange(len(goal))
        d, before = error(rows), np.full(len(goal), np.inf)
        while True:
            going = (d[rows] < before[rows]) & (d[rows] > 1e-10)
            rows = rows[going]
            if not len(rows):
                break
            at[axis][rows] += way[rows] * np.maximum(1e-6 * d[rows], 1e-9)
            before[rows], d[rows] = d[rows], error(rows)
    return at[0], at[1]


def from_cartesian(ref_lat: Column, ref_lon: Column, east: Column, north: Column) -> Column:
    """STRUCT<lat, lon>: from_cartesian_np as a vectorised function (the loop depends on the data)."""

    @F.pandas_udf("lat double, lon double")
    def search(a: pd.Series, b: pd.Series, e: pd.Series, n: pd.Series) -> pd.DataFrame:
        lat, lon = from_cartesian_np(a, b, e, n)
        return pd.DataFrame({"lat": lat, "lon": lon})

    return search(ref_lat, ref_lon, east, north)


def degree_scaling(lat: float, lon: float) -> np.ndarray:
    """Diagonal (metres per degree of latitude, of longitude, 1) about a point."""
    a, b = from_cartesian_np(lat, lon, 1.0, 1.0)
    return np.array([1 / (a[0] - lat), 1 / (b[0] - lon), 1.0])
