"""Points near other points, and the regions that hold them.

Points become unit vectors on a sphere; k-d cuts fitted on a bounded sample split them into
leaves of similar size, each leaf also getting the points within the radius of its border.  Inside
a leaf a local k-d tree finds the pairs by chord and a plane sweep over polygon edges finds the
containing regions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakite.operators.kdtree import LocalTree, Splits, box_of_rect, chord, unit_vectors
from terrakite.plans.stage import staged

LEAF_POINTS = 40_000
SAMPLE_PER_LEAF = 64
MAX_DEPTH = 16
_FOUND = "kind string, first_key bigint, second_key bigint"


def _finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < F.lit(float("inf")))


def sites(points: DataFrame, key: str, x: str, z: str) -> DataFrame:
    """Distinct positions: (x, z, first_key, last_key), the keys being the smallest and largest there.

    Re-delivered rows of a key fall together, as do different keys at one position.  Rows with a
    null key or a coordinate that is null, NaN or infinite take no part.  -0.0 is 0.0.
    """
    p = points.select(F.col(key).cast("long").alias("k"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(z).cast("double") + 0.0).alias("z"))
    p = p.where(F.col("k").isNotNull() & _finite(F.col("x")) & _finite(F.col("z")))
    return p.groupBy("x", "z").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"))


def fit_splits(sites_df: DataFrame, kind: str, leaf_points: int = LEAF_POINTS) -> Splits:
    """k-d cuts for leaves of about `leaf_points`, fitted on SAMPLE_PER_LEAF rows a leaf (at most 2**MAX_DEPTH leaves)."""
    n = sites_df.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / leaf_points))))
    if depth == 0:
        return Splits(0, np.zeros(0, np.int8), np.zeros(0))
    part = sites_df.select("x", "z").sample(min(1.0, SAMPLE_PER_LEAF * 2**depth / n), seed=17).toArrow()
    return Splits.fit(unit_vectors(part["x"].to_numpy(), part["z"].to_numpy(), kind), depth)


def _spread_points(splits: Splits, reach: float, kind: str):
    def run(batches):
        for b in batches:
            x, z = b.column("x").to_numpy(), b.column("z").to_numpy()
            v = unit_vectors(x, z, kind)
            row, leaf = splits.place(v - reach, v + reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int32)), pa.array(splits.home(v)[row] == leaf), b.column("first_key").take(pa.array(row)), pa.array(x[row]), pa.array(z[row])],
                ["leaf", "home", "k", "x", "z"],
            )

    return run


def _spread_regions(splits: Splits, kind: str):
    def run(batches):
        for b in batches:
            lo, hi = box_of_rect(*(b.column(c).to_numpy() for c in ("x0", "z0", "x1", "z1")), kind)
            row, leaf = splits.place(lo, hi)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *(b.column(c).take(at) for c in ("region", "ring_x", "ring_z"))], ["leaf", "region", "ring_x", "ring_z"])

    return run


def sweep(px: np.ndarray, pz: np.ndarray, region: np.ndarray, ax: np.ndarray, az: np.ndarray, bx: np.ndarray, bz: np.ndarray):
    """(region, point) of the points inside or on the border of polygons given as edges a-b.

    A sweep along x: over the points in order of x, an edge is active for a contiguous run of
    them.  A point with an odd number of a region's edges above it is inside; one on an edge is too.
    """
    order = np.argsort(px, kind="stable")
    sx, sz = px[order], pz[order]
    swap = ax > bx
    ax, bx, az, bz = np.where(swap, bx, ax), np.where(swap, ax, bx), np.where(swap, bz, az), np.where(swap, az, bz)
    first, last = np.searchsorted(sx, ax, "left"), np.searchsorted(sx, bx, "right")
    out_r, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_region = np.argsort(region, kind="stable")
    region, ax, az, bx, bz, first, last = (v[by_region] for v in (region, ax, az, bx, bz, first, last))
    bounds = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]])) if len(region) else np.zeros(1, int)
    active = np.concatenate([[0], np.cumsum(last - first)])
    begin = 0
    while begin < len(bounds) - 1:  # as many whole regions at a time as keep the active pairs in memory
        end = begin + 1
        while end < len(bounds) - 1 and active[bounds[end + 1]] - active[bounds[begin]] < 2_000_000:
            end += 1
        e = np.arange(bounds[begin], bounds[end])
        begin = end
        width = (last - first)[e]
        edge = np.repeat(e, width)
        if not len(edge):
            continue
        p = np.arange(len(edge)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[e], width)
        x, z = sx[p], sz[p]
        run = bx[edge] - ax[edge]
        level = az[edge] + (bz[edge] - az[edge]) * np.divide(x - ax[edge], run, out=np.zeros(len(edge)), where=run > 0)
        upright = run == 0
        on = np.where(upright, (z >= np.minimum(az, bz)[edge]) & (z <= np.maximum(az, bz)[edge]), level == z)
        above = ~upright & (x < bx[edge]) & (level > z)
        code = np.unique(region[edge], return_inverse=True)
        pair, at = np.unique(code[1].astype(np.int64) * len(sx) + p, return_inverse=True)
        held = (np.bincount(at, weights=above) % 2 == 1) | (np.bincount(at, weights=on) > 0)
        out_r.append(code[0][pair[held] // len(sx)])
        out_p.append(order[pair[held] % len(sx)])
    return np.concatenate(out_r), np.concatenate(out_p)


def _found(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]).take(pa.array(np.zeros(len(a), np.int8))), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "first_key", "second_key"])


def _search(radius: float | None, kind: str):
    def run(key, points: pa.Table, regions: pa.Table) -> pa.Table:
        k, x, z, home = (points.column(c).to_numpy() for c in ("k", "x", "z", "home"))
        out = [_found("near", np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if radius is not None and len(k) > 1:
            for i, j in LocalTree(unit_vectors(x, z, kind)).pairs(chord(radius, kind)):
                if kind == "plane":
                    dx, dz = x[i] - x[j], z[i] - z[j]
                    ok = dx * dx + dz * dz <= radius * radius
                    i, j = i[ok], j[ok]
                i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
                own = home[i]  # the leaf that is home to the smaller key reports the pair
                out.append(_found("near", k[i[own]], k[j[own]]))
        if regions.num_rows and len(k):
            rx, rz = regions.column("ring_x").combine_chunks(), regions.column("ring_z").combine_chunks()
            size = rx.value_lengths().to_numpy()
            vx, vz = rx.flatten().to_numpy(), rz.flatten().to_numpy()
            stop = np.cumsum(size)
            nxt = np.arange(len(vx)) + 1
            nxt[stop - 1] = stop - size
            r, p = sweep(x[home], z[home], np.repeat(np.arange(len(size)), size), vx, vz, vx[nxt], vz[nxt])
            out.append(_found("inside", regions.column("region").to_numpy()[r], k[home][p]))
        return pa.Table.from_batches(out)

    return run


def rect_rings(rects: DataFrame, key: str, lower: str, upper: str) -> DataFrame:
    """(region, ring) of axis-parallel rectangles from corner structs with fields x, y.

    Rectangles with a null key, a null or NaN corner, or lower > upper on an axis are left out;
    exact copies count once; a rectangle without width still holds the points on it.
    """
    x0, z0, x1, z1 = (F.col(f"{c}.{f}").cast("double") for c, f in ((lower, "x"), (lower, "y"), (upper, "x"), (upper, "y")))
    ok = F.col(key).isNotNull()
    for c in (x0, z0, x1, z1):
        ok = ok & c.isNotNull() & ~F.isnan(c)
    corner = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    return rects.where(ok & (x0 <= x1) & (z0 <= z1)).select(F.col(key).cast("long").alias("region"), F.array(corner(x0, z0), corner(x1, z0), corner(x1, z1), corner(x0, z1)).alias("ring")).distinct()


def near_sites(sites_df: DataFrame, radius: float | None, rings: DataFrame | None = None, kind: str = "plane", leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(kind, first_key, second_key) between distinct positions, each named by its smallest key.

    `near`: two positions at most `radius` metres apart, once, smaller key first.  `inside`:
    a region of `rings` (region, ring of structs x, z) and a position in it, border included.
    `sites_df` is read more than once, so stage it.
    """
    splits = fit_splits(sites_df, kind, leaf_points)
    spread = sites_df.select("first_key", "x", "z").mapInArrow(_spread_points(splits, chord(radius or 0.0, kind), kind), "leaf int, home boolean, k bigint, x double, z double")
    if rings is None:
        none = sites_df.sparkSession.createDataFrame([], "leaf int, region bigint, ring_x array<double>, ring_z array<double>")
        return spread.groupBy("leaf").cogroup(none.groupBy("leaf")).applyInArrow(_search(radius, kind), _FOUND)
    flat = rings.select("region", F.transform("ring", lambda p: p["x"]).alias("ring_x"), F.transform("ring", lambda p: p["z"]).alias("ring_z"))
    flat = flat.where(F.size("ring_x") > 0).select("*", *[f(F.col(c)).alias(o) for c, f, o in (("ring_x", F.array_min, "x0"), ("ring_z", F.array_min, "z0"), ("ring_x", F.array_max, "x1"), ("ring_z", F.array_max, "z1"))])
    areas = flat.mapInArrow(_spread_regions(splits, kind), "leaf int, region bigint, ring_x array<double>, ring_z array<double>")
    return spread.groupBy("leaf").cogroup(areas.groupBy("leaf")).applyInArrow(_search(radius, kind), _FOUND)


def near_and_inside(points: DataFrame, key: str, x: str, z: str, radius: float | None, rings: DataFrame | None = None, kind: str = "plane", leaf_points: int = LEAF_POINTS) -> DataFrame:
    """All keyed pairs: near_sites, with the keys that share a position written out.

    Returns (kind, first_key, second_key): `near` pairs have the smaller key first and no key
    pairs with itself; `inside` rows are (region, key).  Empty inputs give no rows.  Extra columns
    of `points` are ignored.  A key delivered at several positions stands at each of them.
    """
    at = staged(sites(points, key, x, z), "sites")
    found = near_sites(at, radius, rings, kind, leaf_points)
    shared = at.where(F.col("first_key") != F.col("last_key"))
    if shared.isEmpty():
        return found
    p = points.select(F.col(key).cast("long").alias("k"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(z).cast("double") + 0.0).alias("z"))
    members = staged(p.join(shared, ["x", "z"]).select(F.col("first_key").alias("rep"), "k").distinct(), "members")
    a, b = members.select(F.col("rep").alias("ra"), F.col("k").alias("ka")), members.select(F.col("rep").alias("rb"), F.col("k").alias("kb"))
    full = found.join(a, (F.col("kind") == "near") & (F.col("first_key") == F.col("ra")), "left").join(b, F.col("second_key") == F.col("rb"), "left")
    one, two = F.coalesce("ka", "first_key"), F.coalesce("kb", "second_key")
    near = F.col("kind") == "near"
    full = full.select("kind", F.when(near, F.least(one, two)).otherwise(one).alias("first_key"), F.when(near, F.greatest(one, two)).otherwise(two).alias("second_key"))
    if radius is None:
        return full
    same = a.join(b, (F.col("ra") == F.col("rb")) & (F.col("ka") < F.col("kb"))).select(F.lit("near").alias("kind"), F.col("ka").alias("first_key"), F.col("kb").alias("second_key"))
    return full.unionByName(same).where("kind <> 'near' OR first_key < second_key").distinct()


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Landmarks within 0.25 m on the ground plane, and the rectangles that hold a landmark."""
    from terrakite.plans.stage import table

    rings = rect_rings(table(spark, sf_dir, "rects"), "rect_id", "lower", "upper")
    return near_and_inside(table(spark, sf_dir, "landmarks"), "id", "x", "z", 0.25, rings)


FOUND_SQL = """
WITH l AS (SELECT id, arg_min(x, received_at) AS x, arg_min(z, received_at) AS z FROM landmarks
 WHERE id IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL AND isfinite(x) AND isfinite(z) GROUP BY id),
g AS (SELECT id, x, z, CAST(floor(x / 0.25) AS BIGINT) AS gx, CAST(floor(z / 0.25) AS BIGINT) AS gz FROM l),
h AS (SELECT id, x, z, gx + dx AS gx, gz + dz AS gz FROM g, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dz)),
r AS (SELECT DISTINCT rect_id, lower.x AS x0, lower.y AS z0, upper.x AS x1, upper.y AS z1 FROM rects WHERE rect_id IS NOT NULL)
SELECT 'near' AS kind, a.id AS first_key, b.id AS second_key FROM g a JOIN h b ON a.gx = b.gx AND a.gz = b.gz AND a.id < b.id
 WHERE (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 0.0625
UNION ALL
SELECT 'inside', rect_id, id FROM r JOIN l ON x >= x0 AND x <= x1 AND z >= z0 AND z <= z1
 WHERE x0 IS NOT NULL AND z0 IS NOT NULL AND x1 IS NOT NULL AND z1 IS NOT NULL AND NOT isnan(x1) AND NOT isnan(z1)
"""
