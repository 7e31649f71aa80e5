"""Depth and confidence pictures (PFM) of frames, read as files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakite.functions import camera

MAPS = "frame_id BIGINT, width INT, height INT, depth BINARY, confidence BINARY"


def read_depth(spark: SparkSession, folder: str) -> DataFrame:
    """MAPS rows of the files <8 digits>_depth.pfm and <8 digits>_confidence.pfm: float32 pictures, row by row, confidence as weights.

    A frame without one of the two, or whose two differ in size, or whose file is broken, is left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfm").load(folder)
    part = lambda i: F.regexp_extract("path", r"(\d{8})_(depth|confidence)\.pfm$", i)
    named = files.select(part(1).try_cast("long").alias("frame_id"), part(2).alias("kind"), "content").where("kind <> '' AND frame_id IS NOT NULL")

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        try:
            both = {k: camera.read_pfm(c) for k, c in zip(df["kind"], df["content"])}
            d, c = camera.saved_depth(both["depth"], both["confidence"])
        except (KeyError, ValueError):
            return pd.DataFrame(columns=["frame_id", "width", "height", "depth", "confidence"])
        return pd.DataFrame([(key[0], d.shape[1], d.shape[0], d.astype("<f4").tobytes(), c.astype("<f4").tobytes())], columns=["frame_id", "width", "height", "depth", "confidence"])

    return named.groupBy("frame_id").applyInPandas(one, MAPS)


def at_keypoints(maps: DataFrame, keypoints: DataFrame, frames: DataFrame, width: int = 1920, height: int = 1440) -> DataFrame:
    """keypoints (frame_id, idx, x, y) with depth, depth_confidence and the surface normal in the world; frames: id, intrinsics, extrinsics."""
    f = frames.select(F.col("id").alias("frame_id"), F.get("intrinsics", F.lit(0)).alias("f"), "extrinsics")
    right = maps.join(f, "frame_id")

    def one(key: tuple, k: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = k[["frame_id", "idx", "x", "y"]].copy()
        if not len(m):
            return out.assign(depth=None, depth_confidence=None, normal=None)
        r = m.iloc[0]
        d, c = (np.frombuffer(r[n], "<f4").reshape(r["height"], r["width"]) for n in ("depth", "confidence"))
        out["depth"], out["depth_confidence"] = camera.sample_bilinear(d, k["x"], k["y"], width, height), camera.sample_bilinear(c, k["x"], k["y"], width, height)
        out["normal"] = camera.surface_normals(d, r["f"] * r["width"] / width, np.array(r["extrinsics"], float).reshape(4, 4, order="F"), k["x"], k["y"], width, height).tolist()
        return out

    return keypoints.groupBy("frame_id").cogroup(right.groupBy("frame_id")).applyInPandas(one, "frame_id bigint, idx int, x float, y float, depth double, depth_confidence double, normal array<double>")
