"""Global alignment: the affine origin that takes map metres to latitude, longitude and altitude."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from terrakite.functions.geo import degree_scaling
from terrakite.operators.aggregates import centroids, cross_covariance


def align(gps: DataFrame) -> np.ndarray | None:
    """The 4 x 4 origin from fixes (rel_x, rel_y, rel_z, lat, lon, alt, ha); None with fewer than two.

    Weighted centroids and covariance are aggregates; only their 6 and 9 numbers reach the driver.
    Rotation: U V' of the covariance without a correction of the determinant, with the cells that the
    covariance leaves out set to zero again.
    """
    gps = gps.dropna(subset=["rel_x", "rel_y", "rel_z", "lat", "lon", "alt", "ha"])
    if gps.limit(2).count() < 2:
        return None
    c = centroids(gps).first().asDict()
    scale = degree_scaling(c["lat"], c["lon"])
    m = np.array(list(cross_covariance(gps, c, tuple(map(float, scale))).first()), float).reshape(3, 3)
    u, _, vt = np.linalg.svd(m)
    r = u @ vt
    r[[0, 1, 2, 2], [1, 1, 0, 2]] = 0.0
    t = np.eye(4)
    t[:3, :3] = np.diag(1 / scale) @ r
    rc, gc = np.array([c["rel_x"], c["rel_y"], c["rel_z"]]), np.array([c["lat"], c["lon"], c["alt"]])
    t[:3, 3] = gc - t[:3, :3] @ rc
    return t
