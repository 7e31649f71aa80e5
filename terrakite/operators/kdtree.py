"""k-d trees over three-dimensional unit vectors: global splits for partitioning, local trees for search.

Both are plain arrays, walked a level at a time for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EARTH_RADIUS_M = 6_371_008.8


def unit_vectors(a: np.ndarray, b: np.ndarray, kind: str = "plane", radius: float = EARTH_RADIUS_M) -> np.ndarray:
    """Points as unit vectors, n x 3.

    `sphere`: a, b are longitude and latitude in degrees.  `plane`: a, b are metres east and
    north on a plane, wrapped on a sphere of `radius`: longitude a/radius, latitude b/radius.  The
    wrapping never lengthens a distance (meridians converge), so every pair within r on the plane
    is within the chord r/radius; pairs it brings too close are sorted out afterwards.
    """
    lon, lat = (np.radians(a), np.radians(b)) if kind == "sphere" else (a / radius, b / radius)
    c = np.cos(lat)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)], axis=1)


def chord(distance: float, kind: str = "plane", radius: float = EARTH_RADIUS_M) -> float:
    """The chord that no pair within `distance` metres exceeds, with room for rounding."""
    arc = min(distance / radius, np.pi)
    straight = 2 * np.sin(arc / 2) if kind == "sphere" else arc
    return float(straight * (1 + 1e-9) + 1e-14)


def _cos_range(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = 2 * np.pi
    top = np.floor(hi / two) >= np.ceil(lo / two)
    low = np.floor((hi - np.pi) / two) >= np.ceil((lo - np.pi) / two)
    a, b = np.cos(lo), np.cos(hi)
    return np.where(low, -1.0, np.minimum(a, b)), np.where(top, 1.0, np.maximum(a, b))


def box_of_rect(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, kind: str = "plane", radius: float = EARTH_RADIUS_M) -> tuple[np.ndarray, np.ndarray]:
    """Boxes in space (n x 3 lower, upper) around plane or longitude-latitude rectangles."""
    f = np.radians if kind == "sphere" else (lambda v: v / radius)
    lon0, lon1, lat0, lat1 = (np.clip(f(v), -1e6, 1e6) for v in (ax, bx, ay, by))
    c0, c1 = _cos_range(lat0, lat1)
    parts = []
    for k0, k1 in (_cos_range(lon0, lon1), _cos_range(lon0 - np.pi / 2, lon1 - np.pi / 2)):
        p = np.stack([c0 * k0, c0 * k1, c1 * k0, c1 * k1])
        parts.append((p.min(0), p.max(0)))
    parts.append(_cos_range(lat0 - np.pi / 2, lat1 - np.pi / 2))
    slack = 1e-12
    return np.stack([p[0] for p in parts], 1) - slack, np.stack([p[1] for p in parts], 1) + slack


@dataclass(frozen=True)
class Splits:
    """A complete binary tree of cuts in heap order; its 2**depth leaves are the partitions."""

    depth: int
    dim: np.ndarray
    cut: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> "Splits":
        """Median cuts along the widest side of each cell of `sample`."""
        dim, cut = np.zeros(2**depth - 1, np.int8), np.zeros(2**depth - 1)
        cells = {0: sample}
        for node in range(2**depth - 1):
            v = cells.pop(node)
            if len(v):
                d = int(np.argmax(v.max(0) - v.min(0)))
                x = np.sort(v[:, d])
                c = x[(len(x) - 1) // 2]
                dim[node], cut[node] = d, c
                left = v[:, d] <= c
            else:
                left = np.zeros(0, bool)
            if 2 * node + 1 < 2**depth - 1:
                cells[2 * node + 1], cells[2 * node + 2] = v[left], v[~left]
        return Splits(depth, dim, cut)

    def place(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that the box lo..hi of a row touches."""
        row, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for _ in range(self.depth):
            d, c = self.dim[node], self.cut[node]
            left, right = lo[row, d] <= c, hi[row, d] > c
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.depth - 1)

    def home(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), np.int64)
        at = np.arange(len(v))
        for _ in range(self.depth):
            node = 2 * node + np.where(v[at, self.dim[node]] <= self.cut[node], 1, 2)
        return node - (2**self.depth - 1)


class LocalTree:
    """A k-d tree over one partition, cut down to buckets of a few points."""

    BUCKET = 12

    def __init__(self, v: np.ndarray):
        n = len(v)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / self.BUCKET))))
        order = np.arange(n)
        start = np.array([0, n])
        for _ in range(self.depth):
            size = np.diff(start)
            cell = np.repeat(np.arange(len(size)), size)
            x, at = v[order], np.minimum(start[:-1], max(n - 1, 0))
            width = np.maximum.reduceat(x, at, axis=0) - np.minimum.reduceat(x, at, axis=0)
            key = x[np.arange(n), np.argmax(width, axis=1)[cell]]
            order = order[np.lexsort((key, cell))]
            start = np.sort(np.concatenate([start, start[:-1] + (size + 1) // 2]))
        self.order, self.start = order, start
        x = v[order]
        self.v = x
        leaf = np.minimum(start[:-1], max(n - 1, 0))
        lo, hi = (np.minimum.reduceat(x, leaf, axis=0), np.maximum.reduceat(x, leaf, axis=0)) if n else (np.zeros((1, 3)), np.zeros((1, 3)))
        empty = np.diff(start) == 0
        lo[empty], hi[empty] = np.inf, -np.inf
        self.boxes = [(lo, hi)]
        for _ in range(self.depth):
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.boxes.insert(0, (lo, hi))

    def pairs(self, r: float, chunk: int = 60_000):
        """Yields (i, j), i != j each way once, of all points within the chord r: the tree against itself."""
        if len(self.order) < 2:
            return
        a = b = np.zeros(1, np.int64)
        for level in range(self.depth):
            a, b = np.repeat(a, 4), np.repeat(b, 4)
            a, b = 2 * a + np.tile([0, 0, 1, 1], len(a) // 4), 2 * b + np.tile([0, 1, 0, 1], len(b) // 4)
            up = a <= b
            a, b = a[up], b[up]
            lo, hi = self.boxes[level + 1]
            gap = np.maximum(0, np.maximum(lo[a] - hi[b], lo[b] - hi[a]))
            near = np.einsum("ij,ij->i", gap, gap) <= r * r
            a, b = a[near], b[near]
        size = np.diff(self.start)
        w = int(size.max())
        for k in range(0, len(a), chunk):
            p, q = a[k : k + chunk], b[k : k + chunk]
            i = self.start[p][:, None, None] + np.arange(w)[None, :, None]
            j = self.start[q][:, None, None] + np.arange(w)[None, None, :]
            ok = (np.arange(w)[None, :, None] < size[p][:, None, None]) & (np.arange(w)[None, None, :] < size[q][:, None, None]) & (i < j)
            i, j = np.broadcast_to(i, ok.shape)[ok], np.broadcast_to(j, ok.shape)[ok]
            d = self.v[i] - self.v[j]
            near = np.einsum("ij,ij->i", d, d) <= r * r
            yield self.order[i[near]], self.order[j[near]]
