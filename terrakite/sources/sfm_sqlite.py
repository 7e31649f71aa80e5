"""The SQLite database of a structure-from-motion run, as a Spark data source and a writer.

    spark.dataSource.register(SfmDatabase)
    spark.read.format("sfm_database").option("table", "keypoints").load(path)

Every partition is a range of image ids with as many images as the others, so large databases are read in parallel.
"""

from __future__ import annotations

import sqlite3

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrakite.functions import camera
from terrakite.sources.schema import DESCRIPTOR_BYTES
from terrakite.sources.session import image_name

_SCHEMAS = {
    "images": "image_id int, name string, positioned boolean",
    "keypoints": "image_id int, idx int, x float, y float, size float, angle float, scale double, orientation double",
    "descriptors": "image_id int, idx int, desc binary",
}
PINHOLE, WIDTH, HEIGHT = 1, 1920, 1440
PRIOR_VARIANCE = 10.0
_BATCH_ROWS = 20_000


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SfmDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sfm_database"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("table", "images")]

    def reader(self, schema) -> "SfmReader":
        return SfmReader(self.options)


class SfmReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"].removeprefix("file:"), options.get("table", "images")
        # of the images themselves a partition holds many; of keypoints and descriptors an image has thousands
        self.images = int(options.get("imagesPerPartition", "250000" if self.table == "images" else "64"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            key = db.execute(f"SELECT min(image_id) FROM {self.table}").fetchone()
            starts = []
            while key and key[0] is not None:
                starts.append(key[0])
                key = db.execute(f"SELECT image_id FROM {self.table} WHERE image_id > ? ORDER BY image_id LIMIT 1 OFFSET ?", (key[0], self.images - 1)).fetchone()
            hi = db.execute(f"SELECT max(image_id) FROM {self.table}").fetchone()[0]
        return [_Range(x, y - 1) for x, y in zip(starts, [*starts[1:], hi + 1])] if starts else [_Range(0, -1)]

    def read(self, part: _Range):
        with self._open() as db:
            yield from getattr(self, f"_{self.table}")(db, part.lo, part.hi)

    def _images(self, db, lo, hi):
        found = db.execute("SELECT image_id, name FROM images WHERE image_id BETWEEN ? AND ? ORDER BY image_id", (lo, hi))
        while rows := found.fetchmany(_BATCH_ROWS):
            ids, names = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(names, pa.string()), pa.array([False] * len(ids))], ["image_id", "name", "positioned"])

    def _blobs(self, db, lo, hi):
        cols_there = any(c[1] == "cols" for c in db.execute("PRAGMA table_info(keypoints)"))
        for i, cols, data in db.execute(f"SELECT image_id, {'cols' if cols_there else 6}, data FROM keypoints WHERE image_id BETWEEN ? AND ? ORDER BY image_id", (lo, hi)):
            width = cols if cols in (2, 4, 6) else 6
            if data and len(data) % (4 * width) == 0:
                yield i, width, np.frombuffer(data, "<f4").reshape(-1, width)

    def _keypoints(self, db, lo, hi):
        """Six columns are x, y and a 2 x 2 shape for scale and orientation, and are also given as size and angle, their third and fourth; four are x, y, scale, orientation."""
        for i, width, k in self._blobs(db, lo, hi):
            for n, r in enumerate(k.astype(float)):
                size, angle = (r[2], r[3]) if width > 2 else (1.0, 0.0)
                scale, turn = (size, angle) if width != 6 else (float(np.sqrt(abs(r[2] * r[5] - r[3] * r[4]))), float(np.degrees(np.arctan2(r[4], r[2]))))
                yield i, n, float(r[0]), float(r[1]), float(size), float(angle), float(scale), float(turn)

    def _descriptors(self, db, lo, hi):
        """Images whose bytes are not 128 a keypoint are left out."""
        count = {i: len(k) for i, _, k in self._blobs(db, lo, hi)}
        for i, data in db.execute("SELECT image_id, data FROM descriptors WHERE image_id BETWEEN ? AND ? ORDER BY image_id", (lo, hi)):
            if data and len(data) == count.get(i, -1) * DESCRIPTOR_BYTES:
                for n in range(count[i]):
                    yield i, n, data[n * DESCRIPTOR_BYTES : (n + 1) * DESCRIPTOR_BYTES]


def read_database(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, keypoints, descriptors)."""
    spark.dataSource.register(SfmDatabase)
    return tuple(spark.read.format("sfm_database").option("path", path).option("table", t).load() for t in ("images", "keypoints", "descriptors"))


def database_rows(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, images, pose_priors) that a database of these frames holds; image and camera id are frame id + 1."""
    i = lambda n: F.get("intrinsics", F.lit(n))
    e = lambda n: F.get("extrinsics", F.lit(n))
    key = F.col("id") + 1
    cameras = frames.select(key.alias("camera_id"), F.lit(PINHOLE).alias("model"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), i(0).alias("fx"), i(4).alias("fy"), i(6).alias("cx"), i(7).alias("cy"))
    images = frames.select(key.alias("image_id"), image_name(F.col("id")).alias("name"), key.alias("camera_id"))
    priors = frames.select(key.alias("image_id"), e(12).alias("x"), e(13).alias("y"), e(14).alias("z"), F.array(*[F.lit(PRIOR_VARIANCE if a == b else 0.0) for a in range(3) for b in range(3)]).alias("covariance"))
    return cameras, images, priors


def _packed(batches):
    """Arrow batches as one binary value each, so that the driver takes columns and not rows."""
    for b in batches:
        for s in range(0, b.num_rows, _BATCH_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b.slice(s, _BATCH_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])


def _columns(df: DataFrame):
    """Lists of the columns of `df`, a batch at a time: one partition is on the driver while the next is made."""
    for r in df.mapInArrow(_packed, "rows binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(r["rows"]) as t:
            for b in t:
                yield [c.to_pylist() for c in b.columns]


def _doubles(columns: list[str]):
    """A function for mapInArrow: the first column and the bytes of the other ones, little-endian doubles."""

    def run(batches):
        for b in batches:
            if b.num_rows and any(b.column(c).null_count for c in columns):
                raise ValueError(f"a frame lacks one of {columns}")
            raw = np.stack([b.column(c).to_numpy() for c in columns], axis=1).astype("<f8") if b.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c not in columns), pa.array([x.tobytes() for x in raw], pa.binary())], [*(c for c in b.schema.names if c not in columns), "blob"])

    return run


def create_database(frames: DataFrame, path: str) -> None:
    """A database file with the rows of database_rows.  SQLite has one writer, so the rows go through the driver; executors pack them, and a partition or two are on the driver at once."""
    cameras, images, priors = database_rows(frames)
    params, place = ["fx", "fy", "cx", "cy"], ["x", "y", "z"]
    cameras = cameras.select(*[c for c in cameras.columns if c not in params], *[F.col(c).cast("double").alias(c) for c in params])
    priors = priors.select("image_id", *[F.col(c).cast("double").alias(c) for c in place])
    covariance = np.diag([PRIOR_VARIANCE] * 3).astype("<f8").tobytes()
    # after a failure the file has to be made anew, so no journal is written
    with sqlite3.connect(path, isolation_level=None) as db:
        db.executescript(
            """PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; PRAGMA cache_size = -20000;
            CREATE TABLE cameras (camera_id INTEGER PRIMARY KEY, model INTEGER, width INTEGER, height INTEGER, params BLOB, prior_focal_length INTEGER);
            CREATE TABLE images (image_id INTEGER PRIMARY KEY, name TEXT UNIQUE, camera_id INTEGER);
            CREATE TABLE pose_priors (image_id INTEGER PRIMARY KEY, position BLOB, coordinate_system INTEGER, position_covariance BLOB);
            CREATE TABLE keypoints (image_id INTEGER PRIMARY KEY, rows INTEGER, cols INTEGER, data BLOB);
            CREATE TABLE descriptors (image_id INTEGER PRIMARY KEY, rows INTEGER, cols INTEGER, data BLOB);
            CREATE TABLE two_view_geometries (pair_id INTEGER PRIMARY KEY, rows INTEGER, cols INTEGER, data BLOB, config INTEGER, qvec BLOB, tvec BLOB);
            BEGIN;"""
        )
        kinds = lambda df, gone: ", ".join([*(f"{n} {k}" for n, k in df.dtypes if n not in gone), "blob binary"])
        for c in _columns(cameras.mapInArrow(_doubles(params), kinds(cameras, params))):
            db.executemany("INSERT INTO cameras VALUES (?, ?, ?, ?, ?, 1)", zip(*c))
        for c in _columns(images):
            db.executemany("INSERT INTO images VALUES (?, ?, ?)", zip(*c))
        for c in _columns(priors.mapInArrow(_doubles(place), kinds(priors, place))):
            db.executemany("INSERT INTO pose_priors VALUES (?, ?, 1, ?)", ((i, p, covariance) for i, p in zip(*c)))
        db.execute("COMMIT")


def missing_pairs(frames: DataFrame, stored: DataFrame, order: str = "id") -> DataFrame:
    """(pair_id, first, second, relative_pose): consecutive frames whose pair is not among `stored` (pair_id)."""
    from terrakite.functions import se3
    from terrakite.plans.stage import numbered

    n = numbered(frames.select("id", order, "extrinsics") if order != "id" else frames.select("id", "extrinsics"), "_n", order)
    nxt = n.select((F.col("_n") - 1).alias("_n"), F.struct("id", "extrinsics").alias("n"))
    p = n.join(nxt, "_n")
    a, b = F.col("id") + 1, F.col("n.id") + 1
    pairs = p.select(camera.pair_id(a, b).alias("pair_id"), a.alias("first"), b.alias("second"), se3.relative_pose(se3.flip_camera(F.col("extrinsics")), se3.flip_camera(F.col("n.extrinsics"))).alias("relative_pose"))
    return pairs.join(stored.select("pair_id"), "pair_id", "left_anti")
