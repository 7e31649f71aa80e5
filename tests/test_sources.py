import base64
import gzip
import json
import sqlite3
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakite.operators import reconstruction
from terrakite.plans.queries import QUERIES, SQL
from terrakite.sources import graph_text, session, sfm_sqlite, sfm_text

EYE = np.eye(4).ravel(order="F").tolist()


@pytest.fixture
def folder(tmp_path):
    frames = [{"id": i, "timestamp": 10 * i, "intrinsics": [1.0] * 9, "extrinsics": EYE} for i in range(3)]
    gps = [{"timestamp": -4268353914581502026, "relative": [1.0, 2.0, 3.0], "global": [37.5, 139.9, 0.0], "accuracy": [10.0, 10.0, -1.0]}]
    lm = [{"id": 4, "desc": base64.b64encode(bytes(range(128))).decode(), "position": [1.0, 2.0, 3.0], "orientation": [0.0, 0.0, 1.0], "sightings": 5, "bounds": {"lower": {"x": -1.0, "y": -2.0}, "upper": {"x": 3.0, "y": 4.0}}}]
    m = {"origin_ready": True, "origin": EYE, "landmarks": lm, "anchors": [[0, {"id": 0, "frame_id": 2, "transform": EYE, "relative_transform": EYE}]], "edges": [[0, [1, 1]], [1, [0, 0]]]}
    for name, doc in (("frames", frames), ("gps", gps), ("map", m)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    return tmp_path


def tables(s):
    return {n: sorted(map(str, getattr(s, n).collect())) for n in ("frames", "gps", "landmarks", "anchors", "edges", "meta")}


def test_session_round_trips(spark, folder, tmp_path):
    s = session.read_session(spark, str(folder))
    got = tables(s)
    assert len(got["frames"]) == 3 and len(got["edges"]) == 4 and s.landmarks.first().desc == bytes(range(128))
    session.write_session(s, str(tmp_path / "json"))
    assert tables(session.read_session(spark, str(tmp_path / "json"))) == got
    session.write_tables(s, str(tmp_path / "parquet"))
    assert tables(session.read_tables(spark, str(tmp_path / "parquet"))) == got
    assert [r.id for r in session.add_frame(s.frames, 99, [1.0] * 9, EYE).orderBy("id").collect()] == [0, 1, 2, 3]
    assert s.frames.select(session.file_prefix(F.col("id"))).first()[0] == "00000000_"


def document(folder):
    """The parts of a written document put together."""
    return json.loads(b"".join(gzip.decompress(p.read_bytes()) for p in sorted(folder.glob("part-*"))))


def many(spark, n):
    """A session of `n` rows a table in 6 partitions, a third of the fixes equal, some values missing."""
    eye = F.array(*[F.lit(v) for v in EYE])
    rows = spark.range(0, n, 1, 6)
    frames = rows.select("id", (F.col("id") * 10).alias("timestamp"), F.when(F.col("id") % 5 > 0, eye).alias("intrinsics"), eye.alias("extrinsics"))
    gps = rows.select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-9).alias("timestamp"), *[F.array(F.lit(1.5), F.lit(-0.25), F.lit(3.0)).alias(c) for c in ("relative", "global", "accuracy")])
    corner = [F.col("id").cast("double").alias(c) for c in ("lx", "lz", "ux", "uz")]
    lm = rows.select("id", *[F.col("id").cast("double").alias(c) for c in "xyz"], F.array(F.lit(0.5).cast("float")).alias("orientation"), F.when(F.col("id") % 7 > 0, F.lit(bytes(range(128)))).alias("desc"), F.lit(3).alias("sightings"), *corner, F.lit(-1).cast("long").alias("last_seen"))
    anchors = rows.select("id", F.when(F.col("id") % 2 > 0, F.col("id")).alias("frame_id"), eye.alias("transform"), F.when(F.col("id") % 2 > 0, eye).alias("relative_transform"))
    edges = rows.select((F.col("id") % 40).alias("src"), "id").withColumnRenamed("id", "dst")
    return session.Session(frames, gps, lm, anchors, edges, spark.range(1).select(F.lit(True).alias("origin_ready"), eye.alias("origin")))


@pytest.mark.parametrize("table", ["frames", "gps", "landmarks", "anchors", "edges"])
def test_a_table_of_a_session_is_written_and_read_by_many_tasks(spark, tmp_path, table):
    s = many(spark, 600)
    session.write_session(s, str(tmp_path / "out"))
    name = table if table in ("frames", "gps") else "map"
    doc = document(tmp_path / "out" / f"{name}.json")
    assert len(doc if name != "map" else doc[table]) == (40 if table == "edges" else 600)
    back = session.read_session(spark, str(tmp_path / "out"))
    assert tables(back)[table] == tables(s)[table]
    assert getattr(back, table).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("n", [0, 1])
def test_a_session_of_no_or_one_row(spark, tmp_path, n):
    s = many(spark, n)
    session.write_session(s, str(tmp_path / "out"))
    assert len(document(tmp_path / "out" / "frames.json")) == len(document(tmp_path / "out" / "map.json")["edges"]) == n
    assert tables(session.read_session(spark, str(tmp_path / "out"))) == tables(s)


def test_short_descriptors(spark, folder):
    m = json.loads((folder / "map.json").read_text())
    m["landmarks"][0]["desc"] = base64.b64encode(bytes(61)).decode()
    (folder / "map.json").write_text(json.dumps(m))
    with pytest.raises(Exception, match="128 bytes"):
        session.read_session(spark, str(folder)).landmarks.collect()
    assert session.read_session(spark, str(folder), strict=False).landmarks.first().desc is None


def test_model_files(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# comment\n1 1.0 0.0 0.0 0.0 1.0 2.0 3.0 1 1_image.jpeg\n5 6 -1\n2 1 0 0 0 0 0 0 1   with blank.jpeg\n\n")
    (tmp_path / "points3D.txt").write_text("# comment\n1 5.0 6.0 7.0 255 128 64 0.1 1 0 2 3\nbroken line\n2 1 2 3 0 0 0 0.5\n\n")
    images, points = sfm_text.read_model(spark, str(tmp_path))
    assert [(r.image_id, r.tx, r.name) for r in images.orderBy("image_id").collect()] == [(1, 1.0, "1_image.jpeg"), (2, 0.0, "with blank.jpeg")]
    p = {r.point_id: [tuple(t) for t in r.track] for r in points.collect()}
    assert p == {1: [(1, 0), (2, 3)], 2: []}
    with pytest.raises(FileNotFoundError):
        sfm_text.read_model(spark, str(tmp_path / "nowhere"))


def test_poses_by_name(spark):
    frames = spark.createDataFrame([(0, EYE), (1, EYE)], "id bigint, extrinsics array<double>")
    images = spark.createDataFrame([(1, "00000000_image.jpeg", 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0), (2, "other", 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "image_id int, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    got = {r.id: r.pose[12:15] for r in reconstruction.frame_poses(frames, images).collect()}
    assert got == {0: [-1, 2, 3], 1: [0, 0, 0]}


def test_database(spark, tmp_path):
    path = str(tmp_path / "d.db")
    frames = spark.createDataFrame([(i, [1500.0, 0.0, 0.0, 0.0, 1501.0, 0.0, 960.0, 720.0, 1.0], EYE) for i in range(3)], "id bigint, intrinsics array<double>, extrinsics array<double>")
    sfm_sqlite.create_database(frames, path)
    with sqlite3.connect(path) as db:
        k6 = struct.pack("<12f", 1, 2, 3, 0, 0, 3, 4, 5, 0, -2, 2, 0)
        db.execute("INSERT INTO keypoints VALUES (1, 2, 6, ?)", (k6,))
        db.execute("INSERT INTO keypoints VALUES (2, 1, 4, ?)", (struct.pack("<4f", 7, 8, 2, 1),))
        db.execute("INSERT INTO descriptors VALUES (1, 2, 128, ?)", (bytes(256),))
        db.execute("INSERT INTO descriptors VALUES (2, 9, 128, ?)", (bytes(99),))
        assert db.execute("SELECT count(*), min(params) FROM cameras").fetchone() == (3, struct.pack("<4d", 1500, 1501, 960, 720))
    images, kp, desc = sfm_sqlite.read_database(spark, path)
    assert sorted((r.image_id, r.name) for r in images.collect()) == [(i + 1, f"0000000{i}_image.jpeg") for i in range(3)]
    rows = {(r.image_id, r.idx): (r.x, r.y, round(r.scale, 4), round(r.orientation, 4)) for r in kp.collect()}
    assert rows == {(1, 0): (1, 2, 3, 0), (1, 1): (4, 5, 2, 90), (2, 0): (7, 8, 2, 1)}
    assert sorted((r.image_id, r.idx, len(r.desc)) for r in desc.collect()) == [(1, 0, 128), (1, 1, 128)]
    pairs = sfm_sqlite.missing_pairs(frames, spark.createDataFrame([(1 * 2147483647 + 2,)], "pair_id bigint")).collect()
    assert [(r.first, r.second) for r in pairs] == [(2, 3)] and np.array(pairs[0].relative_pose) == pytest.approx(EYE)


def test_a_database_of_sparse_ids_is_read_in_few_partitions(spark, tmp_path):
    path = str(tmp_path / "sparse.db")
    frames = spark.range(0, 3000, 1, 3).select((F.col("id") * 1000).alias("id"), F.array(*[(F.col("id") + i).cast("double") for i in range(9)]).alias("intrinsics"), F.array(*[F.lit(v) for v in EYE[:12]], *[F.col("id") + 0.5] * 3, F.lit(1.0)).alias("extrinsics"))
    sfm_sqlite.create_database(frames, path)
    images, kp, desc = sfm_sqlite.read_database(spark, path)
    assert images.rdd.getNumPartitions() == kp.rdd.getNumPartitions() == 1  # 46,860 with one for every 64 ids
    assert sorted(r.image_id for r in images.collect()) == [1000 * i + 1 for i in range(3000)] and kp.count() == desc.count() == 0
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), count(DISTINCT name) FROM images").fetchone() == (3000, 3000)
        assert db.execute("SELECT params FROM cameras WHERE camera_id = 7001").fetchone() == (struct.pack("<4d", 7, 11, 13, 14),)
        assert db.execute("SELECT position, position_covariance FROM pose_priors WHERE image_id = 7001").fetchone() == (struct.pack("<3d", 7.5, 7.5, 7.5), struct.pack("<9d", 10, 0, 0, 0, 10, 0, 0, 0, 10))


def test_names_of_long_ids_keep_their_digits(spark, tmp_path):
    """Ids of more than eight digits lost their last ones, so that 100000000 and 100000001 had one name."""
    path, want = str(tmp_path / "long.db"), {7: "00000007", 99_999_999: "99999999", 100_000_000: "100000000", 100_000_001: "100000001", 2_147_483_646: "2147483646"}
    frames = spark.createDataFrame([(i, [1.0] * 9, EYE) for i in want], "id bigint, intrinsics array<double>, extrinsics array<double>")
    sfm_sqlite.create_database(frames, path)
    images = sfm_sqlite.read_database(spark, path)[0]
    assert {r.image_id - 1: r.name for r in images.collect()} == {i: f"{n}_image.jpeg" for i, n in want.items()}
    assert sorted(r.value.split()[0] for r in sfm_text.reference_lines(frames).collect()) == sorted(f"{n}_image.jpeg" for n in want.values())
    posed = images.select("image_id", "name", *[F.lit(v).alias(c) for c, v in zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), (1.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0))])
    assert [abs(r.pose[12]) for r in reconstruction.frame_poses(frames, posed).collect()] == [3.0] * 5


def test_model_database_has_every_frame(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 99_999_000).write.parquet(str(tmp_path / "orders.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = db.execute(SQL["model_database"]).fetchall()
        assert len(want) == db.execute("SELECT count(*) FROM orders").fetchone()[0] > db.execute("SELECT count(*) FROM orders WHERE o_orderkey < 100000000").fetchone()[0]
    assert sorted(map(tuple, QUERIES["model_database"](spark, str(tmp_path)).collect())) == sorted(want)


def test_text_lines(spark):
    f = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0, bytes(range(128))), (1, 1, 1.5, 2.0, 3.0, 4.0, b"short")], "image_id int, idx int, x double, y double, scale double, orientation double, desc binary")
    lines = sfm_text.feature_lines(f).first().lines
    assert lines[0] == "1 128" and lines[1].startswith("1.000000 2.000000 3.000000 4.000000 0 1 2 ") and lines[1].endswith(" 126 127")
    fr = spark.createDataFrame([(7, EYE[:12] + [1.0, 2.0, 3.0, 1.0])], "id bigint, extrinsics array<double>")
    assert sfm_text.reference_lines(fr).first()[0] == "00000007_image.jpeg 1.0000000000 -2.0000000000 -3.0000000000"


def test_graph_round_trips(spark, tmp_path):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    lines = graph_text.graph_lines(
        mk([(1, [1500.0, 9.0, 8.0, 0.0])], "id bigint, values array<double>"), mk([(0, [0.5] * 7, True)], "id bigint, values array<double>, fixed boolean"), mk([(24, [1.0, 2.0, 3.0])], "id bigint, values array<double>"),
        mk([(0, 1, [1.0] * 28)], "a bigint, b bigint, values array<double>"), mk([(24, 0, 1, [1.0] * 9)], "point bigint, pose bigint, camera bigint, values array<double>"),
    )
    graph_text.write_graph(lines, str(tmp_path / "g"))
    got = {(r.tag, tuple(r.ids), len(r["values"])) for r in graph_text.read_graph(spark, str(tmp_path / "g")).collect()}
    assert got == {("PARAMS_CAMERAPARAMETERS", (1,), 4), ("VERTEX_SE3:EXPMAP", (0,), 7), ("FIX", (0,), 0), ("VERTEX_TRACKXYZ", (24,), 3), ("EDGE_SE3:EXPMAP", (0, 1), 28), ("EDGE_PROJECT_XYZ2UVD:EXPMAP", (24, 0, 1), 9)}
