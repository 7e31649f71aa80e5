"""Queries of the model readers' joins, the location matcher and the tracker, over the map-shaped views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakite.functions import se3
from terrakite.operators import mapedit, reconstruction
from terrakite.plans.map_queries import _GPS, QUERIES, SQL, query, r
from terrakite.plans.views import view
from terrakite.streaming import locations, tracker
from terrakite.streaming.config import TrackerConfig

__all__ = ["QUERIES", "SQL"]


def _eye(x, y, z):
    one = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    return se3.compose(one, (x, y, z))


def _points(spark, d) -> DataFrame:
    """Landmarks as points of a model (y down, z forward) with the frames that saw them as tracks; image = frame + 1, point = place in the frame."""
    track = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "seq"))), lambda s: F.struct((s["frame_id"] + 1).cast("int").alias("image_id"), s["seq"].cast("int").alias("point_idx")))
    t = view(spark, d, "fx_observations").groupBy(F.col("landmark_id").alias("point_id")).agg(track.alias("track"))
    l = view(spark, d, "fx_landmarks").select(F.col("id").alias("point_id"), "x", (-F.col("y")).alias("y"), (-F.col("z")).alias("z"))  # noqa: E741
    return l.join(t, "point_id")


def _descriptors(spark, d) -> DataFrame:
    o = view(spark, d, "fx_observations").select((F.col("frame_id") + 1).cast("int").alias("image_id"), F.col("seq").cast("int").alias("idx")).distinct()
    return o.withColumn("desc", F.encode(F.concat_ws("/", "image_id", "idx"), "UTF-8"))


@query("""SELECT landmark_id AS point_id, arg_min(CAST(frame_id + 1 AS VARCHAR) || '/' || CAST(seq AS VARCHAR), frame_id * 100 + seq) AS descriptor FROM fx_observations GROUP BY 1""")
def first_descriptor(spark, d):
    f = reconstruction.first_descriptors(reconstruction.tracks(_points(spark, d)), _descriptors(spark, d))
    return f.select("point_id", F.decode("desc", "UTF-8").alias("descriptor"))


@query("""WITH o AS (SELECT o.landmark_id AS id, f.cx, f.cy, f.cz, sqrt((l.x - f.cx) * (l.x - f.cx) + (l.y - f.cy) * (l.y - f.cy) + (l.z - f.cz) * (l.z - f.cz)) AS far FROM fx_observations o JOIN fx_frames f ON f.frame_id = o.frame_id JOIN fx_landmarks l ON l.id = o.landmark_id)
 SELECT id, count(*) AS sightings, round(min(cx) - greatest(3, 0.2 * max(far)), 6) AS lx, round(min(cz) - greatest(3, 0.2 * max(far)), 6) AS lz, round(max(cx) + greatest(3, 0.2 * max(far)), 6) AS ux, round(max(cz) + greatest(3, 0.2 * max(far)), 6) AS uz FROM o GROUP BY 1""")
def track_to_landmarks(spark, d):
    f = view(spark, d, "fx_frames").select(F.col("frame_id").alias("id"), F.col("t").alias("timestamp"), _eye(F.col("cx"), F.col("cy"), F.col("cz")).alias("extrinsics"))
    images = f.select((F.col("id") + 1).cast("int").alias("image_id"), F.lit("").alias("name"))
    o = view(spark, d, "fx_observations").select((F.col("frame_id") + 1).cast("int").alias("image_id"), F.col("seq").cast("int").alias("idx")).distinct()
    kp = o.select("image_id", "idx", *[F.lit(0.0).cast("float").alias(c) for c in ("x", "y", "size", "angle")])
    lm, _ = reconstruction.landmarks_from_model(_points(spark, d), images, kp, _descriptors(spark, d), f)
    return lm.select("id", "sightings", *[r(F.col(c)).alias(c) for c in ("lx", "lz", "ux", "uz")])


@query("SELECT a.id, CASE WHEN a.id % 2 = 0 AND f.frame_id IS NOT NULL THEN round(f.cx + a.x, 6) ELSE round(a.x, 6) END AS x, CASE WHEN a.id % 2 = 0 AND f.frame_id IS NOT NULL THEN round(f.cz + a.z, 6) ELSE round(a.z, 6) END AS z FROM fx_anchors a LEFT JOIN fx_frames f ON f.frame_id = a.frame_id")
def anchor_follow(spark, d):
    pose = _eye(F.col("x"), F.col("y"), F.col("z"))
    a = view(spark, d, "fx_anchors").select("id", "frame_id", pose.alias("transform"), F.when(F.col("id") % 2 == 0, pose).alias("relative_transform"))
    f = view(spark, d, "fx_frames").select(F.col("frame_id").alias("id"), _eye(F.col("cx"), F.lit(0.0), F.col("cz")).alias("extrinsics"))
    t = mapedit.follow_frames(a, f)
    return t.select("id", r(se3.at(F.col("transform"), 0, 3)).alias("x"), r(se3.at(F.col("transform"), 2, 3)).alias("z"))


@query(f"WITH {_GPS} SELECT session_id, t, round(lat, 6) AS lat, round(rel_x, 6) AS rel_x, round(rel_z, 6) AS rel_z FROM gps")
def location_match(spark, d):
    p = view(spark, d, "fx_positions").select("session_id", "seq", F.lit("position").alias("kind"), "t", "x", "y", "z", *[F.lit(None).cast("double").alias(c) for c in ("ax", "ay", "az")])
    l = view(spark, d, "fx_locations").select("session_id", "seq", F.lit("location").alias("kind"), "t", F.col("lat").alias("x"), F.col("lon").alias("y"), F.col("alt").alias("z"), F.col("ha").alias("ax"), F.col("ha").alias("ay"), F.lit(-1.0).alias("az"))  # noqa: E741
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("t", F.desc("kind"), "seq"))
    e = p.unionByName(l).withColumn("seq", order.cast("long"))
    return locations.match(e).select("session_id", "t", r(F.col("lat")).alias("lat"), r(F.col("rel_x")).alias("rel_x"), r(F.col("rel_z")).alias("rel_z"))


def _events(spark, d) -> DataFrame:
    """Every measurement as a step of the device, every third as a localization too."""
    m = view(spark, d, "fx_measurements")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("t", "seq"))
    m = m.withColumn("n", n)
    none = lambda t: F.lit(None).cast(t)
    inl = "array<struct<x:double,y:double,z:double,u:double,v:double,size:double,response:double,octave:int>>"
    row = lambda kind, seq, pose: [F.col("session_id").alias("device"), seq.cast("long").alias("seq"), F.col("t"), F.lit(kind).alias("kind"), pose.alias("pose"), none("bigint").alias("captured"), F.lit(60).alias("total_matches"), none("array<double>").alias("intrinsics"), none(inl).alias("inliers")]
    vio = m.select(*row("vio", 2 * F.col("n"), _eye(0.1 * F.col("n"), F.lit(0.0), F.lit(0.0))))
    located = m.where("n % 3 = 0").select(*row("located", 2 * F.col("n") + 1, _eye(0.1 * F.col("n") + F.col("z") / 1000, F.lit(0.0), F.lit(1.0))))
    return vio.unionByName(located)


def _fusion(name: str):
    def f(spark, d):
        c = TrackerConfig(filter_strategy=name, confidence_estimator="simple", outlier_detector="distance")
        t = tracker.track(_events(spark, d), c)
        return t.select("device", "seq", "kind", "success", "outlier", "streak", r(se3.at(F.col("pose"), 0, 3)).alias("x"), r(se3.at(F.col("pose"), 2, 3)).alias("z"))

    f.__name__ = f"tracker_{name}"
    return query()(f)


for _name in ("pass_through", "averaging", "kalman", "smooth"):
    _fusion(_name)
