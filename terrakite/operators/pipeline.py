"""The map builder's pipelines, composed of the operators: build from a sparse model, refine, save, ingest frames, localize against a map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.functions import camera, se3
from terrakite.operators import aggregates, alignment, asof, bundle, localize, mapedit, matching, reconstruction, spatial
from terrakite.plans.stage import staged
from terrakite.sources.session import Session


def gps_rows(gps: DataFrame) -> DataFrame:
    """Fixes in the columns of alignment: rel_x .. alt and ha, with t and one session."""
    at = lambda c, i: F.get(F.col(f"`{c}`"), F.lit(i)).cast("double")
    names = [("relative", ("rel_x", "rel_y", "rel_z")), ("global", ("lat", "lon", "alt"))]
    return gps.select(F.lit(0).alias("session_id"), F.col("timestamp").alias("t"), *[at(c, i).alias(n) for c, ns in names for i, n in enumerate(ns)], at("accuracy", 0).alias("ha"), "accuracy")


def _gps_table(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("t").alias("timestamp"), F.array("rel_x", "rel_y", "rel_z").alias("relative"), F.array("lat", "lon", "alt").alias("global"), "accuracy")


def aligned(s: Session) -> Session:
    """The session with a new origin from its fixes; unchanged with fewer than two."""
    t = alignment.align(gps_rows(s.gps))
    if t is None:
        return s
    row = [(True, t.ravel(order="F").tolist())]
    return s.with_(meta=s.meta.sparkSession.createDataFrame(row, "origin_ready boolean, origin array<double>"))


def reinterpolated(s: Session) -> Session:
    """Fixes with relative positions taken anew from the frames' poses."""
    x, y, z = se3.position(F.col("extrinsics"))
    path = s.frames.select(F.lit(0).alias("session_id"), F.col("timestamp").alias("t"), F.col("id").alias("frame_id"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
    return s.with_(gps=_gps_table(asof.reinterpolate(gps_rows(s.gps), path)))


def rescaled(s: Session, factor: float) -> Session:
    """Landmarks, anchors and bounds scaled about the anchor of smallest id, fixes interpolated anew."""
    if factor <= 0:
        return s
    x, y, z = se3.position(F.col("transform"))
    where = staged(mapedit.pivot_of(s.anchors.select("id", x.alias("x"), y.alias("y"), z.alias("z"))), "pivot")
    p = F.broadcast(where)
    moved = [p_ + (v - p_) * factor for p_, v in zip((F.col("px"), F.col("py"), F.col("pz")), (x, y, z))]
    anchors = s.anchors.crossJoin(p).withColumn("transform", se3.compose(se3.rotation(F.col("transform")), tuple(moved))).select(*s.anchors.columns)
    return reinterpolated(s.with_(anchors=anchors, landmarks=mapedit.rescale(s.landmarks, factor, where, bounds=True)))


def with_model(s: Session, points: DataFrame, images: DataFrame, keypoints: DataFrame, descriptors: DataFrame) -> tuple[Session, DataFrame]:
    """(session with the model's landmarks added, observations): align, then points with tracks become landmarks."""
    lm, obs = reconstruction.landmarks_from_model(points, images, keypoints, descriptors, s.frames)
    base = aligned(s)
    return base.with_(landmarks=base.landmarks.unionByName(lm.select(*base.landmarks.columns))), obs


def refined(s: Session, observations: DataFrame, model_images: DataFrame | None = None, **schedule) -> Session:
    """Frames, landmarks and anchors after refinement; frames start from the model's poses where it has them."""
    start = None
    if model_images is not None:
        start = {r.id: np.array(r.pose, float).reshape(4, 4, order="F") for r in reconstruction.frame_poses(s.frames, model_images).select("id", "pose").toLocalIterator()}
    o = observations.select("landmark_id", "frame_id", F.col("kpt.x").cast("double").alias("u"), F.col("kpt.y").cast("double").alias("v"), F.col("kpt.octave").alias("octave"))
    r = bundle.refine(s.frames, s.landmarks, o, start, **schedule)
    poses = [(i, p.ravel(order="F").tolist()) for i, p in bundle.device_poses(r.cameras).items()]
    new = s.frames.sparkSession.createDataFrame(poses, "id bigint, _pose array<double>")
    frames = s.frames.join(new, "id", "left").withColumn("extrinsics", F.coalesce("_pose", "extrinsics")).drop("_pose")
    at = r.points.select(F.col("landmark_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    landmarks = s.landmarks.join(at, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("x", "y", "z") else F.col(c) for c in s.landmarks.columns])
    cx, cy, cz = se3.position(F.col("extrinsics"))
    seen = r.errors.where("level = 0").select(F.col("landmark_id").alias("id"), "frame_id").join(frames.select(F.col("id").alias("frame_id"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz")), "frame_id")
    return s.with_(frames=frames, landmarks=aggregates.inlier_update(landmarks, seen), anchors=mapedit.follow_frames(s.anchors, frames))


def saved(s: Session) -> Session:
    """What is saved after refinement: landmarks seen too rarely culled, fixes interpolated anew, the origin aligned."""
    return aligned(reinterpolated(s.with_(landmarks=aggregates.cull(s.landmarks))))


def ingest(landmarks: DataFrame, features: DataFrame, frames: DataFrame, side: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(landmarks, links): frames taken up one after another, each against the landmarks that the ones before it made.

    features: frame_id, idx, u, v, size, depth, vector; landmarks: id, x, y, z, vector, lx, lz, ux, uz,
    sightings; frames: id, intrinsics, extrinsics.  A feature that matches a landmark about the camera
    is linked to it, any other becomes a new one at its depth.  Each frame needs the result of the last,
    so the loop over frames is the caller's batch size: give frames far apart as one table to others.
    """
    links = None
    cx, cy, cz = se3.position(F.col("extrinsics"))
    for f in frames.select("id", "intrinsics", "extrinsics", cx.alias("cx"), cz.alias("cz")).orderBy("id").collect():
        mine = features.where(F.col("frame_id") == f.id)
        near = spatial.find(landmarks, spatial.query_square(F.lit(f.cx), F.lit(f.cz), side), 2**17)
        nn = matching.k_nearest(mine, near, 8, "idx", "id", "vector")
        accepted = matching.split_matches(nn, "idx").groupBy("idx").agg(F.min_by("id", F.struct("rank")).alias("id"))
        pose, k = F.array(*map(F.lit, f.extrinsics)), f.intrinsics
        x, y, z = camera.project_to_world(pose, F.lit(k[0]), F.lit(k[6]), F.lit(k[7]), F.col("u"), F.col("v"), F.col("depth"))
        at = mine.select("idx", x.alias("x"), y.alias("y"), z.alias("z"))
        link, everything = matching.match_or_create(at, accepted, landmarks, "idx", "id")
        link = staged(link.withColumn("frame_id", F.lit(f.id)), "links")
        made = link.where("created").join(mine.select("idx", "vector"), "idx").select(F.col("landmark_id").alias("id"), "vector")
        new = everything.join(made, "id")
        box = aggregates.camera_bounds(new, new.select("id", F.lit(f.cx).alias("cx"), F.lit(float(f.extrinsics[13])).alias("cy"), F.lit(f.cz).alias("cz")))
        seen = link.groupBy(F.col("landmark_id").alias("id")).agg(F.count("*").alias("_n"))
        grown = landmarks.join(seen, "id", "left").withColumn("sightings", F.col("sightings") + F.coalesce("_n", F.lit(0))).drop("_n")
        landmarks = staged(grown.unionByName(new.join(box, "id").withColumn("sightings", F.lit(1)).select(*[F.col(c).cast(grown.schema[c].dataType).alias(c) for c in grown.columns])), "landmarks")
        links = link if links is None else links.unionByName(link)
    return landmarks, links


def localize_frames(landmarks: DataFrame, features: DataFrame, frames: DataFrame, side: float = 10.0, cell: float = 16.0, **search) -> DataFrame:
    """localize.FOUND rows of frames against a map: candidates by a range join about each camera, nearest descriptors within them, match order, consensus pose.

    features: frame_id, idx, u, v, size, vector; landmarks as in ingest; frames: id, intrinsics,
    extrinsics (where to look; `side` <= 0 looks everywhere), gravity.
    """
    q = features.withColumn("query", F.col("frame_id") * F.lit(2**24).cast("long") + F.col("idx"))
    if side > 0:
        x, _, z = se3.position(F.col("extrinsics"))
        at = frames.select(F.col("id").alias("frame_id"), x.alias("cx"), z.alias("cz"))
        about = spatial.range_join(at, landmarks, spatial.query_square(F.col("cx"), F.col("cz"), side), spatial.Rect.named(), cell)
        nn = matching.k_nearest(q, about.select("frame_id", F.col("id").alias("landmark_id"), "vector"), 8, "query", "landmark_id", "vector", group="frame_id")
    else:
        everything = spatial.candidates(landmarks, 0.0, 0.0, 0.0)
        nn = matching.k_nearest(q, everything.select(F.col("id").alias("landmark_id"), "vector"), 8, "query", "landmark_id", "vector")
    split = matching.split_matches(nn, "query").withColumn("frame_id", F.shiftright("query", 24))
    ordered = matching.match_order(split, q.select("query", "size"), "query", "landmark_id", per="frame_id")
    pts = landmarks.select(F.col("id").alias("landmark_id"), "x", "y", "z")
    m = ordered.join(q.select("query", "u", "v"), "query").join(pts, "landmark_id").select("frame_id", "landmark_id", "position", "x", "y", "z", "u", "v")
    return localize.localize(m, frames.select(F.col("id").alias("frame_id"), "intrinsics", "gravity"), **search)


def best_poses(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Frames with `pose`: the localized one where localization succeeded, else the device's."""
    f = found.where("success").select(F.col("frame_id").alias("id"), F.col("pose").alias("_pose"))
    return frames.join(f, "id", "left").withColumn("pose", F.coalesce("_pose", "extrinsics")).drop("_pose")


def inlier_observations(found: DataFrame, matches: DataFrame) -> DataFrame:
    """(landmark_id, frame_id, u, v, cam_pose) of the inliers of successful localizations, to be appended to the observations."""
    inl = found.where("success").select("frame_id", F.col("pose").alias("cam_pose"), F.explode("inlier_landmarks").alias("landmark_id"))
    return matches.select("frame_id", "landmark_id", "u", "v").join(inl, ["frame_id", "landmark_id"])
