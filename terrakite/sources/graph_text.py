"""Pose graphs in the line format of g2o: read to one table of lines, written from vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many ids a line of each tag starts with.
IDS = {"PARAMS_CAMERAPARAMETERS": 1, "VERTEX_SE3:EXPMAP": 1, "FIX": 1, "VERTEX_TRACKXYZ": 1, "EDGE_SE3:EXPMAP": 2, "EDGE_SE3:EXPMAP:GRAVITY": 1, "EDGE_PROJECT_XYZ2UVD:EXPMAP": 3}


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(tag, ids, values) of every line with a known tag."""
    f = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("f")).select(F.get("f", F.lit(0)).alias("tag"), "f")
    n = F.create_map(*[x for k, v in IDS.items() for x in (F.lit(k), F.lit(v))])[F.col("tag")]
    g = f.where(F.col("tag").isin(*IDS)).withColumn("n", n)
    part = lambda a, b, t: F.transform(F.slice("f", a, F.greatest(b, F.lit(0))), lambda v: v.cast(t))
    return g.select("tag", part(F.lit(2), F.col("n"), "long").alias("ids"), part(F.col("n") + 2, F.size("f") - 1 - F.col("n"), "double").alias("values"))


def _line(tag: str, ids: list[Column], values: Column | None) -> Column:
    parts = [F.lit(tag), *[i.cast("string") for i in ids]]
    if values is not None:
        parts.append(F.array_join(F.transform(values, lambda v: v.cast("string")), " "))
    return F.concat_ws(" ", *parts)


def graph_lines(cameras: DataFrame, poses: DataFrame, points: DataFrame, odometry: DataFrame, projections: DataFrame) -> DataFrame:
    """(value): the lines of a graph.

    cameras: id, values (f, cx, cy, baseline); poses: id, values (x y z qx qy qz qw), fixed;
    points: id, values (x y z); odometry: a, b, values (7 and 21 of the information's upper triangle);
    projections: point, pose, camera, values (u v depth and 6 of the information's upper triangle).
    """
    c = F.col
    out = cameras.select(_line("PARAMS_CAMERAPARAMETERS", [c("id")], c("values")).alias("value"))
    out = out.unionAll(poses.select(_line("VERTEX_SE3:EXPMAP", [c("id")], c("values"))))
    out = out.unionAll(poses.where("fixed").select(_line("FIX", [c("id")], None)))
    out = out.unionAll(points.select(_line("VERTEX_TRACKXYZ", [c("id")], c("values"))))
    out = out.unionAll(odometry.select(_line("EDGE_SE3:EXPMAP", [c("a"), c("b")], c("values"))))
    return out.unionAll(projections.select(_line("EDGE_PROJECT_XYZ2UVD:EXPMAP", [c("point"), c("pose"), c("camera")], c("values"))))


def write_graph(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
