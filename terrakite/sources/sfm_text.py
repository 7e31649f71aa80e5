"""Text files of a sparse model: points, images, features, reference positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): data lines in order of their place in the file, comments left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return text.where(~F.col("value").startswith("#"))


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, x, y, z, track): track is an array of (image_id, point_idx).  Comments, blank and broken lines are left out; colour and error are ignored."""
    p = spark.read.text(path).where(~F.trim("value").startswith("#")).select(F.split(F.trim("value"), "\\s+").alias("f"))
    num = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    rest = F.slice("f", 9, F.greatest(F.size("f") - 8, F.lit(0)))
    track = F.transform(F.sequence(F.lit(0), F.expr("int(size(f) - 8) div 2 - 1")), lambda i: F.struct(F.get(rest, i * 2).try_cast("int").alias("image_id"), F.get(rest, i * 2 + 1).try_cast("int").alias("point_idx")))
    track = F.when(F.size("f") >= 10, track).otherwise(F.array().cast("array<struct<image_id:int,point_idx:int>>"))
    out = p.select(num(0, "long").alias("point_id"), num(1, "double").alias("x"), num(2, "double").alias("y"), num(3, "double").alias("z"), track.alias("track"), F.size("f").alias("_n"))
    return out.where("_n >= 8 AND point_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").drop("_n")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name): the first of every two data lines; the name is the rest of the line."""
    d = _lines(spark, path).select("file", "n", "value")
    numbered = d.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l")).select(F.posexplode("l").alias("i", "l"))
    first = numbered.where("i % 2 = 0").select(F.trim("l.value").alias("v")).where("v <> ''")
    f = first.select(F.split("v", "\\s+", 10).alias("f")).where("size(f) = 10")
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    out = f.select(F.get("f", F.lit(0)).try_cast("int").alias("image_id"), *[F.get("f", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)], F.get("f", F.lit(8)).try_cast("int").alias("camera_id"), F.get("f", F.lit(9)).alias("name"))
    return out.dropna(subset=["image_id", *names])


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(images, points) of a folder; both files have to be there."""
    for name in ("images.txt", "points3D.txt"):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(f"{folder}/{name}")
    return read_images(spark, f"{folder}/images.txt"), read_points3d(spark, f"{folder}/points3D.txt")


def feature_lines(features: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, lines): the feature file of every image: `N 128`, then x y scale orientation and 128 values a line, six decimals.

    `features`: image, idx, x, y, scale, orientation, desc (128 bytes).
    """
    byte = lambda i: F.conv(F.hex(F.substring("desc", i, 1)), 16, 10)
    line = F.concat_ws(" ", *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("x", "y", "scale", "orientation")], *[byte(i) for i in range(1, 129)])
    rows = features.where("length(desc) = 128").select(image, "idx", line.alias("line"))
    g = rows.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return g.select(image, F.concat(F.array(F.concat(F.size("l").cast("string"), F.lit(" 128"))), F.transform("l", lambda s: s["line"])).alias("lines"))


def affine_to_scale(a11, a12, a21, a22):
    """(scale, orientation in degrees) of an affine keypoint shape."""
    return F.sqrt(F.abs(a11 * a22 - a12 * a21)), F.degrees(F.atan2(a21, a11))


def reference_lines(frames: DataFrame) -> DataFrame:
    """(value): `name X Y Z` of every frame with Y and Z negated, ten decimals."""
    from terrakite.functions import se3
    from terrakite.sources.session import image_name

    x, y, z = se3.position(F.col("extrinsics"))
    return frames.select(F.format_string("%s %.10f %.10f %.10f", image_name(F.col("id")), x, -y, -z).alias("value"))
