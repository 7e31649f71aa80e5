"""Aggregates over observations, cameras, fixes and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USABLE_SIGHTINGS = 3


def usable(landmarks: DataFrame) -> DataFrame:
    """Landmarks seen often enough: sightings >= 3.  A null count is too few."""
    return landmarks.where(F.col("sightings") >= USABLE_SIGHTINGS)


cull = usable


def weight(ha: Column) -> Column:
    """1 / ha**2; below 1e-4 the weight is 1e-4."""
    return F.when(ha < 1e-4, F.lit(1e-4)).otherwise(1 / (ha * ha))


def centroids(gps: DataFrame) -> DataFrame:
    """One row of weighted means of rel_x, rel_y, rel_z, lat, lon, alt, weighted by accuracy ha; nulls of a column are left out with their weight."""
    w = weight(F.col("ha"))
    return gps.agg(*[(F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in ("rel_x", "rel_y", "rel_z", "lat", "lon", "alt")])


def cross_covariance(gps: DataFrame, centre: dict[str, float], scale: tuple[float, float, float]) -> DataFrame:
    """One row c00..c22 of sum of scale * (global - gc) * w * (relative - rc)'; cells 01, 11, 20, 22 are zero."""
    w = weight(F.col("ha"))
    g = [scale[i] * (F.col(c) - centre[c]) for i, c in enumerate(("lat", "lon", "alt"))]
    r = [F.col(c) - centre[c] for c in ("rel_x", "rel_y", "rel_z")]
    zero = {(0, 1), (1, 1), (2, 0), (2, 2)}
    return gps.agg(*[(F.lit(0.0) if (i, j) in zero else F.coalesce(F.sum(g[i] * w * r[j]), F.lit(0.0))).alias(f"c{i}{j}") for i in range(3) for j in range(3)])


def _distance(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in list(zip(a, b))[1:]), (F.col(a[0]) - F.col(b[0])) * (F.col(a[0]) - F.col(b[0]))))


def camera_bounds(landmarks: DataFrame, seen: DataFrame, key: str = "id", margin: float = 0.2, floor: float = 3.0, include_landmark: bool = False) -> DataFrame:
    """(key, lx, lz, ux, uz): the box of the cameras (cx, cy, cz) that saw each landmark, widened.

    `seen`: key, cx, cy, cz, a row per sighting.  The margin is `margin` times the largest distance in
    space, at least `floor`.  Without cameras the box is one metre about the landmark.  The landmark
    itself does not widen the box unless `include_landmark`.
    """
    j = landmarks.select(key, "x", "y", "z").join(seen.select(key, "cx", "cy", "cz"), key)
    g = j.groupBy(key).agg(F.max(_distance(("cx", "cy", "cz"), ("x", "y", "z"))).alias("_far"), F.min("cx").alias("_x0"), F.max("cx").alias("_x1"), F.min("cz").alias("_z0"), F.max("cz").alias("_z1"))
    out = landmarks.select(key, "x", "z").join(g, key, "left")
    m = F.greatest(F.lit(float(floor)), margin * F.col("_far"))
    lo, hi = (lambda c, own: F.least(c, F.col(own)) if include_landmark else c), (lambda c, own: F.greatest(c, F.col(own)) if include_landmark else c)
    pick = lambda cam, own, sign: F.when(F.col("_far").isNull(), F.col(own) + sign).otherwise((lo if sign < 0 else hi)(F.col(cam), own) + sign * m)
    return out.select(key, pick("_x0", "x", -1).alias("lx"), pick("_z0", "z", -1).alias("lz"), pick("_x1", "x", 1).alias("ux"), pick("_z1", "z", 1).alias("uz"))


def recorded_observations(landmarks: DataFrame, seen: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """(key, lx, lz, ux, uz, sightings, last_seen): landmarks after recording sightings one by one.

    Each sighting adds a square about its camera whose side is twice the horizontal distance;
    last_seen is the time of the last by `order`, and so is `orientation`, if `seen` has one.  Landmarks
    without sightings are left out.
    """
    turned = ["orientation"] if "orientation" in seen.columns else []
    j = landmarks.select(key, "x", "z").join(seen.select(key, "cx", "cz", "t", order, *turned), key)
    half = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("z") - F.col("cz")) * (F.col("z") - F.col("cz")))
    j = j.withColumn("_h", half)
    return j.groupBy(key).agg(
        F.min(F.col("cx") - F.col("_h")).alias("lx"), F.min(F.col("cz") - F.col("_h")).alias("lz"), F.max(F.col("cx") + F.col("_h")).alias("ux"), F.max(F.col("cz") + F.col("_h")).alias("uz"),
        F.count("*").alias("sightings"), F.max_by("t", F.col(order)).alias("last_seen"), *[F.max_by(c, F.col(order)).alias(c) for c in turned],
    )


def window_landmarks(observations: DataFrame, keyframes: DataFrame, size: int, group: str = "session_id", order: str = "n", frame: str = "frame_id", landmark: str = "landmark_id") -> DataFrame:
    """(group, frame, landmarks, observations): what the window of the last `size` keyframes up to each one holds.

    `keyframes`: group, frame and `order`, whole numbers without gaps in each group.  A landmark counts once as long as
    one keyframe of the window sees it.  Every observation is copied to the `size` windows it is in and
    counted per landmark before the shuffle.  A window without observations has 0 of both.
    """
    k = keyframes.select(group, frame, order)
    o = observations.select(frame, landmark).join(k, frame)
    in_windows = o.select(group, landmark, F.explode(F.sequence(F.col(order), F.col(order) + (size - 1))).alias(order))
    held = in_windows.groupBy(group, order, landmark).agg(F.count("*").alias("c")).groupBy(group, order).agg(F.count("*").alias("landmarks"), F.sum("c").alias("observations"))
    return k.join(held, [group, order], "left").select(group, frame, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("landmarks", "observations")])


def frame_stats(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(frame_id, landmarks, usable): landmarks seen per frame and how many of them are usable."""
    l = landmarks.select(F.col("id").alias("landmark_id"), (F.coalesce(F.col("sightings"), F.lit(0)) >= USABLE_SIGHTINGS).alias("_u"))  # noqa: E741
    return observations.select("frame_id", "landmark_id").distinct().join(l, "landmark_id").groupBy("frame_id").agg(F.count("*").alias("landmarks"), F.count_if("_u").alias("usable"))


def most_connected_frame(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """One row (frame_id, n): the frame with most observations of usable landmarks, ties to the smaller id; (0, 0) if there is none."""
    l = usable(landmarks).select(F.col("id").alias("landmark_id"))  # noqa: E741
    best = observations.join(l, "landmark_id").groupBy("frame_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("frame_id")).limit(1)
    return best.agg(F.coalesce(F.max("frame_id"), F.lit(0)).alias("frame_id"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def reprojection_summary(errors: DataFrame, error: str = "error", inlier: Column | None = None) -> DataFrame:
    """One row (mean_error, n) over inliers."""
    some = errors if inlier is None else errors.where(inlier)
    return some.agg(F.avg(error).alias("mean_error"), F.count(error).alias("n"))


def rmse(errors: DataFrame, by: str, error: str = "error", behind: str = "behind") -> DataFrame:
    """(by, rmse, n): root mean square per group; points behind the camera are skipped; a group of only such has infinite rmse."""
    good = F.when(~F.col(behind), F.col(error))
    return errors.groupBy(by).agg(F.coalesce(F.sqrt(F.avg(good * good)), F.lit(float("inf"))).alias("rmse"), F.count(good).alias("n"))


def mark_outliers(edges: DataFrame, limit: float, chi2: str = "chi2", odometry: str = "is_odometry", odometry_factor: float = 2.3) -> DataFrame:
    """`edges` with `outlier` (chi2 beyond the limit) and `level`: 1 takes an edge out of the next round.  Odometry edges are judged at a wider limit and never taken out."""
    over = F.when(F.col(odometry), F.col(chi2) > limit * odometry_factor).otherwise(F.col(chi2) > limit)
    return edges.withColumn("outlier", over).withColumn("level", (over & ~F.col(odometry)).cast("int"))


def inlier_update(landmarks: DataFrame, inliers: DataFrame, key: str = "id", margin: float = 0.2) -> DataFrame:
    """Landmarks with bounds and sightings from inlier cameras; no inliers: 0 sightings, bounds as they were."""
    counts = inliers.groupBy(key).agg(F.count("*").alias("_n"))
    box = camera_bounds(landmarks.join(counts.select(key), key, "left_semi"), inliers, key, margin)
    names = landmarks.columns
    j = landmarks.join(counts, key, "left").join(box.select(key, *[F.col(c).alias(f"_{c}") for c in ("lx", "lz", "ux", "uz")]), key, "left")
    fresh = {c: F.coalesce(f"_{c}", c) for c in ("lx", "lz", "ux", "uz")} | {"sightings": F.coalesce("_n", F.lit(0))}
    return j.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in names])


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row (median, n): element n div 2 of the sorted values, found by rank over range partitions rather than in one list."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    counts = v.groupBy("v").agg(F.count("*").alias("c"))
    # an exact weighted rank: distinct values with counts, cut into ranges whose totals are summed first
    n = v.count()
    if not n:
        return df.sparkSession.createDataFrame([(None, 0)], "median double, n bigint")
    return counts.sparkSession.createDataFrame([(_nth(counts, n // 2), n)], "median double, n bigint")


def _nth(counts: DataFrame, k: int, most: int = 100_000) -> float:
    """The value at position k (from 0) of a table of (v, c): narrowed by approximate quantiles until few rows are left."""
    while True:
        size = counts.count()
        if size <= most:
            rows = counts.orderBy("v").collect()
            for r in rows:
                if k < r.c:
                    return r.v
                k -= r.c
            raise IndexError("position beyond the end")
        cut = counts.approxQuantile("v", [i / 16 for i in range(1, 16)], 0.001)
        below = counts.agg(*[F.coalesce(F.sum(F.when(F.col("v") < c, F.col("c"))), F.lit(0)).alias(f"b{i}") for i, c in enumerate(cut)]).first()
        lo = max([(c, below[i]) for i, c in enumerate(cut) if below[i] <= k], default=(None, 0))
        hi = min([c for i, c in enumerate(cut) if below[i] > k], default=None)
        inside = (F.lit(True) if lo[0] is None else F.col("v") >= lo[0]) & (F.lit(True) if hi is None else F.col("v") < hi)
        counts, k = counts.where(inside), k - lo[1]


def scale_ratios(pairs: DataFrame) -> DataFrame:
    """Ratios of device to optimised distance between consecutive frames, where both are above 0.1 m.  `pairs`: device, optimised."""
    return pairs.where((F.col("device") > 0.1) & (F.col("optimised") > 0.1)).select((F.col("device") / F.col("optimised")).alias("ratio"))


def distance_distribution(inliers: DataFrame, by: str, near: float = 5.0, far: float = 25.0, distance: str = "distance") -> DataFrame:
    """(by, n, near, mid, far, mean, std, least, most): distances of matched landmarks, std of the population."""
    d = F.col(distance)
    return inliers.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(d < near).alias("near"), F.count_if((d >= near) & (d <= far)).alias("mid"), F.count_if(d > far).alias("far"),
        F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("least"), F.max(d).alias("most"),
    )


def scale_quality(inliers: DataFrame, by: str, size: str = "size") -> DataFrame:
    """(by, quality): min(1, mean / 20) * exp(-variance / 100) of keypoint sizes."""
    return inliers.groupBy(by).agg((F.least(F.lit(1.0), F.avg(size) / 20) * F.exp(-F.var_pop(size) / 100)).alias("quality"))


def image_spread(inliers: DataFrame, by: str, u: str = "u", v: str = "v", scale: float = 2.0, least: int = 4) -> DataFrame:
    """(by, n, spread): area of the keypoints' box over 640 x 480 times `scale`, at most 1; 0.1 with fewer than `least`."""
    w = F.max(F.floor(u)) - F.min(F.floor(u)) + 1
    h = F.max(F.floor(v)) - F.min(F.floor(v)) + 1
    spread = F.least(F.lit(1.0), w * h / F.lit(640.0 * 480.0) * scale)
    return inliers.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") < least, F.lit(0.1)).otherwise(spread).alias("spread"))


def localization_kpis(results: DataFrame) -> DataFrame:
    """One row (frames, success_percent, ms_per_frame, fps) from frame results with `success` and `seconds`."""
    return results.agg(
        F.count("*").alias("frames"), (100.0 * F.count_if("success") / F.count("*")).alias("success_percent"), (1000.0 * F.sum("seconds") / F.count("*")).alias("ms_per_frame"), (F.count("*") / F.sum("seconds")).alias("fps"),
    )
