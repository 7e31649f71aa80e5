"""Edits of a map: anchors, edges, origin and scale.  Each returns the changed table; nothing is changed in place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakite.functions import se3
from terrakite.plans.stage import numbered


def create_anchors(anchors: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """`new` (all columns of `anchors` but the key, and `order`) added under the ids that follow the largest, from 0 in an empty table."""
    top = F.broadcast(anchors.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_top")))
    given = numbered(new, "_n", order).crossJoin(top).withColumn(key, F.col("_top") + F.col("_n"))
    return anchors.unionByName(given.select(*anchors.columns))


def attach(anchor_transform: Column, frame_extrinsics: Column) -> Column:
    """Pose of a new anchor relative to its frame: the frame's inverse times the anchor."""
    return se3.multiply(se3.invert_rigid(frame_extrinsics), anchor_transform)


def follow_frames(anchors: DataFrame, frames: DataFrame) -> DataFrame:
    """Anchors with transform = pose of their frame times their relative pose; those without frame or relative pose stay.  `frames`: id, extrinsics."""
    f = frames.select(F.col("id").alias("frame_id"), F.col("extrinsics").alias("_pose"))
    j = anchors.join(f, "frame_id", "left")
    moved = F.when(F.col("_pose").isNotNull() & F.col("relative_transform").isNotNull(), se3.multiply(F.col("_pose"), F.col("relative_transform")))
    return j.withColumn("transform", F.coalesce(moved, F.col("transform"))).select(*anchors.columns)


def update_anchors(anchors: DataFrame, changed: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """`fields` overwritten by those of `changed` where it has the key; unknown keys are ignored."""
    new = changed.select(key, F.struct(*fields).alias("_new"))
    j = anchors.join(new, key, "left")
    return j.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in anchors.columns])


def remove_anchors(anchors: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Anchors and edges without the anchors of `gone` and every edge that touches one."""
    g = gone.select(F.col(key).alias("_g")).distinct()
    kept = anchors.join(g, F.col(key) == F.col("_g"), "left_anti")
    left = edges.join(g, F.col("src") == F.col("_g"), "left_anti").join(g, F.col("dst") == F.col("_g"), "left_anti")
    return kept, left


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Both directions of every new edge; duplicates are kept."""
    n = new.select("src", "dst")
    return edges.unionByName(n).unionByName(n.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without any copy of the edges of `gone`, in either direction."""
    g = gone.select("src", "dst")
    both = g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges.join(both, ["src", "dst"], "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): what a listener would be told: added, updated or removed."""
    h = lambda df, n: df.select(key, F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias(n))
    j = h(before, "_b").join(h(after, "_a"), key, "full")
    what = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "updated")
    return j.select(key, what.alias("change")).where(F.col("change").isNotNull())


def pivot_of(anchors: DataFrame) -> DataFrame:
    """One row (px, py, pz): position of the anchor of smallest id, the origin if there are none."""
    p = anchors.agg(F.min_by(F.struct("x", "y", "z"), "id").alias("p"))
    return p.select(*[F.coalesce(f"p.{c}", F.lit(0.0)).alias(f"p{c}") for c in "xyz"])


def rescale(rows: DataFrame, factor: float, pivot: DataFrame, points: tuple[str, ...] = ("x", "y", "z"), bounds: bool = False) -> DataFrame:
    """Positions (and bounds) moved away from the pivot by `factor`; a factor of 0 or less changes nothing."""
    if factor <= 0:
        return rows
    j = rows.crossJoin(F.broadcast(pivot))
    axis = {points[0]: "px", points[1]: "py", points[2]: "pz"} | ({"lx": "px", "ux": "px", "lz": "pz", "uz": "pz"} if bounds else {})
    return j.select(*[(F.col(axis[c]) + (F.col(c) - F.col(axis[c])) * factor).alias(c) if c in axis else F.col(c) for c in rows.columns])


def rescale_without_edges(landmarks: DataFrame, inlier_ids: DataFrame, factor: float, pivot: DataFrame, key: str = "id") -> DataFrame:
    """Only landmarks without an inlier edge are moved: the optimiser has moved the others."""
    loose = landmarks.join(inlier_ids.select(key).distinct(), key, "left_anti")
    fixed = landmarks.join(inlier_ids.select(key).distinct(), key, "left_semi")
    return fixed.unionByName(rescale(loose, factor, pivot, bounds=True))


def global_point(origin: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """origin times point."""
    o = np.asarray(origin, float)
    return tuple(float(o[i, 0]) * x + float(o[i, 1]) * y + float(o[i, 2]) * z + float(o[i, 3]) for i in range(3))


def relative_point(origin: np.ndarray, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Inverse origin times point."""
    return global_point(np.linalg.inv(np.asarray(origin, float)), a, b, c)
