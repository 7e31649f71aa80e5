"""From a sparse model to a map: points with tracks become landmarks and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.functions import se3
from terrakite.operators.aggregates import camera_bounds
from terrakite.plans.stage import staged
from terrakite.sources.session import image_name

BOX_MARGIN, BOX_FLOOR = 0.2, 3.0


def tracks(points: DataFrame) -> DataFrame:
    """(point_id, pos, image_id, point_idx): one row an element of a track, in order."""
    return points.select("point_id", F.posexplode("track").alias("pos", "t")).select("point_id", "pos", "t.image_id", "t.point_idx")


def first_descriptors(track_rows: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(point_id, desc): the descriptor of the first element of a track that has one.  `descriptors`: image_id, idx, desc."""
    d = descriptors.select("image_id", F.col("idx").alias("point_idx"), "desc")
    j = track_rows.join(d, ["image_id", "point_idx"])
    return j.groupBy("point_id").agg(F.min_by("desc", "pos").alias("desc"))


def landmarks_from_model(points: DataFrame, images: DataFrame, keypoints: DataFrame, descriptors: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landmarks, observations).

    A point becomes a landmark (y and z negated, orientation 0 0 1, sightings = observations,
    bounds from the cameras) if an element of its track has a descriptor and one has a frame: image i
    belongs to frame i - 1.  An observation has the keypoint, the pose of its frame and the distance
    in single precision.  Points without either are left out.  The joined track elements are staged: each
    table is read once, and a landmark is one grouped pass over them.
    """
    t = points.select("point_id", "x", (-F.col("y")).alias("y"), (-F.col("z")).alias("z"), F.posexplode("track").alias("pos", "t"))
    t = t.select("point_id", "x", "y", "z", "pos", F.col("t.image_id").alias("image_id"), F.col("t.point_idx").alias("point_idx"), (F.col("t.image_id") - 1).cast("long").alias("frame_id"))
    kp = keypoints.select("image_id", F.col("idx").alias("point_idx"), F.struct("x", "y", "size", "angle", F.lit(0.0).cast("float").alias("response"), F.lit(0).alias("octave")).alias("kpt"))
    d = descriptors.select("image_id", F.col("idx").alias("point_idx"), "desc")
    fr = frames.select(F.col("id").alias("frame_id"), "timestamp", "extrinsics")
    fr = fr.join(images.select((F.col("image_id") - 1).cast("long").alias("frame_id")), "frame_id", "left_semi").withColumn("seen", F.lit(True))
    cx, cy, cz = se3.position(F.col("extrinsics"))
    of_image = ["image_id", "point_idx"]
    o = t.join(kp.join(d, of_image, "full"), of_image, "left").join(fr, "frame_id", "left").withColumns({"cx": cx, "cy": cy, "cz": cz, "seen": F.coalesce("seen", F.lit(False))})
    far = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("y", "cy"), ("z", "cz"))), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))
    o = staged(o.where("seen OR desc IS NOT NULL").withColumn("far", far), "sightings")
    normal = F.array(*[F.lit(v).cast("float") for v in (0.0, 0.0, 1.0)])
    of_seen = lambda f, c: f(F.when(F.col("seen"), F.col(c)))
    one = o.groupBy("point_id").agg(
        *[F.first(c).alias(c) for c in ("x", "y", "z")], F.count_if("seen").alias("sightings"), F.min_by("desc", F.when(F.col("desc").isNotNull(), F.col("pos"))).alias("desc"),
        F.greatest(F.lit(BOX_FLOOR), BOX_MARGIN * of_seen(F.max, "far")).alias("m"), *[of_seen(f, c).alias(n) for n, f, c in (("x0", F.min, "cx"), ("x1", F.max, "cx"), ("z0", F.min, "cz"), ("z1", F.max, "cz"))],
    ).where("desc IS NOT NULL AND sightings > 0")
    m = F.col("m")
    landmarks = one.select(
        F.col("point_id").alias("id"), "x", "y", "z", "sightings", "desc", (F.col("x0") - m).alias("lx"), (F.col("z0") - m).alias("lz"), (F.col("x1") + m).alias("ux"), (F.col("z1") + m).alias("uz"),
        normal.alias("orientation"), F.lit(-1).cast("long").alias("last_seen"),
    )
    described = o.where("desc IS NOT NULL").select("point_id").distinct()
    observations = o.where("seen").join(described, "point_id", "left_semi").select(
        F.col("point_id").alias("landmark_id"), "frame_id", "timestamp", F.col("extrinsics").alias("cam_pose"), "kpt", F.col("far").cast("float").alias("depth"), F.lit(0.0).cast("float").alias("depth_confidence"), normal.alias("surface_normal"),
    )
    return landmarks, observations


def exported_landmarks(points: DataFrame, poses: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Landmarks of an aligned model for a map file: sightings are the length of the track, bounds include the landmark (margin 0.1, no floor).  `poses`: image_id, cx, cy, cz."""
    t = tracks(points)
    at = points.select(F.col("point_id").alias("id"), "x", (-F.col("y")).alias("y"), (-F.col("z")).alias("z"), F.size("track").alias("sightings"))
    base = at.join(first_descriptors(t, descriptors).withColumnRenamed("point_id", "id"), "id")
    seen = t.join(poses.select("image_id", "cx", "cy", "cz"), "image_id").select(F.col("point_id").alias("id"), "cx", "cy", "cz")
    return base.join(camera_bounds(base, seen, margin=0.1, floor=0.0, include_landmark=True), "id").withColumn("orientation", F.array(*[F.lit(v).cast("float") for v in (0.0, 0.0, 1.0)]))


def frame_poses(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames with `pose`: that of the image with id = frame id + 1 and the frame's name, if it has one, else the device's.  `images`: image_id, name, qw..tz."""
    im = images.select((F.col("image_id") - 1).cast("long").alias("id"), F.col("name").alias("_name"), se3.sfm_pose(*(F.col(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))).alias("_pose"), F.col("qw").isNotNull().alias("_there"))
    j = frames.join(im, "id", "left")
    hit = F.coalesce(F.col("_there") & (F.col("_name") == image_name(F.col("id"))), F.lit(False))
    return j.withColumn("pose", F.when(hit, F.col("_pose")).otherwise(F.col("extrinsics"))).drop("_name", "_pose", "_there")
