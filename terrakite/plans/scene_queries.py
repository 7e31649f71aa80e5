"""Queries of refinement, localization, pose filters and the model database, over a scene made of the whole landmark view.

Six cameras look at all landmarks, moved into their view.  Pixels carry a known noise and known gross errors,
so that SQL can say what the robust operators have to find.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.functions import camera, se3
from terrakite.operators import bundle, localize
from terrakite.plans import state_queries
from terrakite.plans.map_queries import QUERIES, SQL, query, r
from terrakite.plans.stage import staged
from terrakite.plans.views import view
from terrakite.streaming import tracker
from terrakite.streaming.config import TrackerConfig

__all__ = ["QUERIES", "SQL"]

_F, _CX, _CY = 800.0, 320.0, 240.0
_INTRINSICS = [_F, 0.0, 0.0, 0.0, _F, 0.0, _CX, _CY, 1.0]
_CAMERAS = 6


def _pose(i: int) -> np.ndarray:
    return se3.rigid_np(se3.rotation_np(np.array([0.02 * (i % 3 - 1), 0.015 * i - 0.03, 0.01 * (i % 2)])), np.array([0.5 * i, 0.05 * i, 0.0]))


def _landmarks(spark, d) -> DataFrame:
    l = view(spark, d, "fx_landmarks")  # noqa: E741
    return l.select("id", (F.col("x") * 0.08 - 4).alias("x"), (F.col("y") * 0.6 - 3).alias("y"), (F.col("z") * 0.06 - 14).alias("z"), "sightings")


def _frames(spark) -> DataFrame:
    return spark.createDataFrame([(i, _INTRINSICS, _pose(i).ravel(order="F").tolist()) for i in range(_CAMERAS)], "id bigint, intrinsics array<double>, extrinsics array<double>")


def _seen(spark, d) -> DataFrame:
    """(landmark_id, frame_id, x, y, z, u, v): exact pixels and half a pixel of noise."""
    both = _landmarks(spark, d).withColumnRenamed("id", "landmark_id").crossJoin(F.broadcast(_frames(spark).withColumnRenamed("id", "frame_id")))  # six cameras
    u, v = camera.project_to_image(F.col("extrinsics"), F.lit(_F), F.lit(_CX), F.lit(_CY), F.col("x"), F.col("y"), F.col("z"))
    noise = lambda a, b: ((F.col("landmark_id") * a + F.col("frame_id") * b) % 1000) / 1000.0 - 0.5
    return both.select("landmark_id", "frame_id", "x", "y", "z", (u + noise(7919, 104729)).cast("double").alias("u"), (v + noise(15485863, 32452843)).cast("double").alias("v"))


@query("SELECT true AS error_falls, true AS error_is_small, true AS gross_errors_culled, true AS cameras_are_right, count(*) FILTER (sightings >= 3) * 6 AS observations FROM fx_landmarks")
def bundle_adjust(spark, d):
    gross = (F.col("landmark_id") + F.col("frame_id")) % 37 == 0
    o = staged(_seen(spark, d).select("landmark_id", "frame_id", F.when(gross, F.col("u") + 60).otherwise(F.col("u")).alias("u"), "v", F.lit(256).alias("octave")), "observed")
    wobble = lambda c, k: F.col(c) + ((F.col("id") * k) % 101 - 50) / 1000.0
    lm = _landmarks(spark, d).select("id", wobble("x", 31).alias("x"), wobble("y", 57).alias("y"), wobble("z", 83).alias("z"), "sightings")
    off = {i: _pose(i) @ se3.rigid_np(se3.rotation_np(np.array([0.004, -0.005, 0.003]) * (-1) ** i), np.array([0.04, -0.03, 0.05]) * (-1) ** i) for i in range(_CAMERAS)}
    x = bundle.refine(_frames(spark), staged(lm, "moved"), o, off, rounds=((5, 7.378), (3, 5.991)), pose_iterations=3, last=(3, 5.991), buckets=8)
    dev = bundle.device_poses(x.cameras)
    right = max(float(np.linalg.norm((dev[i][:3, 3] - dev[0][:3, 3]) - (_pose(i)[:3, 3] - _pose(0)[:3, 3]))) for i in range(_CAMERAS)) < 0.25
    e = x.errors.select(gross.alias("gross"), (F.col("level") > 0).alias("out"))
    return e.agg(
        F.lit(x.after < x.before / 3).alias("error_falls"), F.lit(x.after < 0.7).alias("error_is_small"),
        ((F.count_if(F.col("gross") & F.col("out")) == F.count_if("gross")) & (F.count_if(F.col("out")) <= 1.1 * F.count_if("gross") + 10)).alias("gross_errors_culled"), F.lit(right).alias("cameras_are_right"), F.count("*").alias("observations"),
    )


@query("SELECT CAST(i AS BIGINT) AS frame_id, count(*) AS matches, true AS success, true AS near, true AS inliers_are_right FROM fx_landmarks, range(6) t(i) GROUP BY i")
def localize_scene(spark, d):
    wrong = (F.col("landmark_id") * 13 + F.col("frame_id")) % 3 == 0
    elsewhere = lambda a, most: ((F.col("landmark_id") * a + F.col("frame_id") * 31) % most).cast("double")
    m = _seen(spark, d).select("frame_id", "landmark_id", F.col("landmark_id").cast("int").alias("position"), "x", "y", "z", F.when(wrong, elsewhere(7907, 640)).otherwise(F.col("u")).alias("u"), F.when(wrong, elsewhere(6151, 480)).otherwise(F.col("v")).alias("v"))
    m = staged(m, "matches")
    f = _frames(spark)
    found = localize.localize(m, f.select(F.col("id").alias("frame_id"), "intrinsics", F.lit(None).cast("array<double>").alias("gravity")), tries=400)
    true = f.select(F.col("id").alias("frame_id"), *[c.alias(n) for c, n in zip(se3.position(F.col("extrinsics")), ("tx", "ty", "tz"))])
    good = m.where(~wrong).groupBy("frame_id").agg(F.count("*").alias("good"))
    j = found.join(true, "frame_id").join(good, "frame_id")
    px, py, pz = se3.position(F.col("pose"))
    off = F.sqrt((px - F.col("tx")) * (px - F.col("tx")) + (py - F.col("ty")) * (py - F.col("ty")) + (pz - F.col("tz")) * (pz - F.col("tz")))
    return j.select("frame_id", F.col("matches").cast("long").alias("matches"), "success", (off < 0.05).alias("near"), ((F.col("inliers") >= 0.98 * F.col("good")) & (F.col("inliers") <= 1.05 * F.col("good") + 5)).alias("inliers_are_right"))


_EVENTS = """m AS (SELECT session_id AS device, t, z / 1000 AS v, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS n FROM fx_measurements),
 l AS (SELECT device, n // 3 AS k, t, v FROM m WHERE n % 3 = 0), e AS (SELECT device, 2 * n AS seq, 'vio' AS kind, n, (n - 1) // 3 AS k FROM m UNION ALL SELECT device, 2 * n + 1, 'located', n, n // 3 FROM m WHERE n % 3 = 0)"""
_SHOWN = "SELECT e.device, e.seq, e.kind, true AS success, false AS outlier, coalesce(round(0.1 * e.n + s.off + 1.7e-8, 6), -1) AS x, CASE WHEN s.off IS NOT NULL THEN 1.0 ELSE -1.0 END::DOUBLE AS z FROM e LEFT JOIN s ON s.device = e.device AND s.k = e.k"


def _filtered(spark, d, name: str) -> DataFrame:
    """-1 stands for no pose yet; the hair added keeps a rounding from depending on the last bit."""
    t = tracker.track(state_queries._events(spark, d), TrackerConfig(filter_strategy=name, confidence_estimator="simple", outlier_detector="distance"))
    return t.select("device", "seq", "kind", "success", "outlier", F.coalesce(r(se3.at(F.col("pose"), 0, 3) + 1.7e-8), F.lit(-1.0)).alias("x"), F.coalesce(r(se3.at(F.col("pose"), 2, 3)), F.lit(-1.0)).alias("z"))


@query(f"WITH {_EVENTS}, s AS (SELECT device, k, v AS off FROM l) {_SHOWN}")
def filter_pass_through(spark, d):
    return _filtered(spark, d, "pass_through")


@query(f"WITH {_EVENTS}, s AS (SELECT device, k, list_reduce(list(v) OVER (PARTITION BY device ORDER BY k), lambda a, b: 0.9 * a + 0.1 * b) AS off FROM l) {_SHOWN}")
def filter_averaging(spark, d):
    return _filtered(spark, d, "averaging")


@query(f"""WITH RECURSIVE {_EVENTS}, s(device, k, t, off, p) AS (SELECT device, k, t, v, CAST(4 AS DOUBLE) FROM l WHERE k = 1 UNION ALL
 SELECT device, k, t, off + (v - off) * (q / (q + 4)), q * (1 - q / (q + 4)) FROM (SELECT l.device, l.k, l.t, l.v, s.off, s.p + 3 * 0.01 * 0.1 + 0.001 * (l.t - s.t) / 1000000 AS q FROM s JOIN l ON l.device = s.device AND l.k = s.k + 1) u) {_SHOWN}""")
def filter_kalman(spark, d):
    return _filtered(spark, d, "kalman")
