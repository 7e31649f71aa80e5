import numpy as np
import pytest

from terrakite.functions import se3
from terrakite.operators import localize, pipeline
from terrakite.sources import pictures
from terrakite.sources.session import Session

K9 = [800.0, 0.0, 0.0, 0.0, 800.0, 0.0, 320.0, 240.0, 1.0]
K = (800.0, 800.0, 320.0, 240.0)


def scene(n=40, frames=3):
    rng = np.random.default_rng(4)
    x = np.stack([rng.uniform(-3, 3, n), rng.uniform(-2, 2, n), rng.uniform(-10, -7, n)], 1)
    vec = rng.uniform(0, 200, (n, 16))
    poses = [se3.rigid_np(np.eye(3), [0.4 * i, 0, 0.0]) for i in range(frames)]
    return x, vec, poses


def tables(spark, x, vec, poses):
    rng = np.random.default_rng(1)
    feats = []
    for i, p in enumerate(poses):
        uv, depth = localize.project(se3.flip_np(p), x, K)
        feats += [(i, j, float(uv[j, 0]), float(uv[j, 1]), 4.0, float(depth[j]), (vec[j] + rng.normal(0, 0.5, 16)).tolist()) for j in range(len(x))]
    f = spark.createDataFrame(feats, "frame_id bigint, idx int, u double, v double, size double, depth double, vector array<double>")
    fr = spark.createDataFrame([(i, K9, p.ravel(order="F").tolist(), [0.0, 1.0, 0.0]) for i, p in enumerate(poses)], "id bigint, intrinsics array<double>, extrinsics array<double>, gravity array<double>")
    return f, fr


LANDMARKS = "id bigint, x double, y double, z double, vector array<double>, lx double, lz double, ux double, uz double, sightings int"


def test_ingest_then_localize(spark):
    x, vec, poses = scene()
    f, fr = tables(spark, x, vec, poses)
    lm, links = pipeline.ingest(spark.createDataFrame([], LANDMARKS), f, fr.limit(2).orderBy("id"))
    rows = sorted(lm.collect(), key=lambda r: r.id)
    assert len(rows) == 40 and {r.sightings for r in rows} == {2}
    assert np.array([(r.x, r.y, r.z) for r in rows]) == pytest.approx(x, abs=1e-6)
    assert links.where("created").count() == 40 and links.count() == 80
    found = {r.frame_id: r for r in pipeline.localize_frames(lm, f, fr, side=20.0, tries=200).collect()}
    for i, p in enumerate(poses):
        assert found[i].success and np.array(found[i].pose).reshape(4, 4, order="F") == pytest.approx(p, abs=1e-2)
    d = pipeline.localize_frames(lm, f, fr, side=0.0, tries=200)
    best = {r.id: r.pose[12] for r in pipeline.best_poses(fr, d).collect()}
    assert best == pytest.approx({0: 0.0, 1: 0.4, 2: 0.8}, abs=1e-2)


def test_session_pipelines(spark):
    eye = np.eye(4).ravel(order="F").tolist()
    pose = lambda v: se3.rigid_np(np.eye(3), [v, 0, 0]).ravel(order="F").tolist()
    s = Session(
        spark.createDataFrame([(0, 0, K9, pose(0.0)), (1, 100, K9, pose(10.0))], "id bigint, timestamp bigint, intrinsics array<double>, extrinsics array<double>"),
        spark.createDataFrame([(50, [0.0, 0.0, 0.0], [37.0, 139.0, 5.0], [5.0, 5.0, -1.0]), (100, [1.0, 0.0, 9.0], [37.0001, 139.0, 5.0], [5.0, 5.0, -1.0])], "timestamp bigint, relative array<double>, global array<double>, accuracy array<double>"),
        spark.createDataFrame([(1, 2.0, 0.0, 0.0, [0.0, 0.0, 1.0], b"", 3, 1.0, 1.0, 3.0, 3.0, -1), (2, 2.0, 0.0, 0.0, [0.0, 0.0, 1.0], b"", 2, 1.0, 1.0, 3.0, 3.0, -1)], "id bigint, x double, y double, z double, orientation array<float>, desc binary, sightings int, lx double, lz double, ux double, uz double, last_seen bigint"),
        spark.createDataFrame([(0, 1, eye, pose(1.0)), (1, None, pose(4.0), None)], "id bigint, frame_id bigint, transform array<double>, relative_transform array<double>"),
        spark.createDataFrame([(0, 1)], "src bigint, dst bigint"),
        spark.createDataFrame([(False, eye)], "origin_ready boolean, origin array<double>"),
    )
    out = pipeline.saved(s)
    assert [r.id for r in out.landmarks.collect()] == [1]
    assert {r.timestamp: r.relative for r in out.gps.collect()} == {50: [5.0, 0.0, 0.0], 100: [10.0, 0.0, 0.0]}
    assert out.meta.first().origin_ready
    two = pipeline.rescaled(s, 2.0)
    assert {r.id: r.transform[12] for r in two.anchors.collect()} == {0: 0.0, 1: 8.0}
    assert {r.x for r in two.landmarks.collect()} == {4.0} and pipeline.rescaled(s, -1.0) is s


def test_depth_pictures(spark, tmp_path):
    pfm = lambda v: b"Pf\n4 3\n-1.0\n" + np.full((3, 4), v, "<f4").tobytes()
    (tmp_path / "00000001_depth.pfm").write_bytes(pfm(2.0))
    (tmp_path / "00000001_confidence.pfm").write_bytes(pfm(2.0))
    (tmp_path / "00000002_depth.pfm").write_bytes(pfm(2.0))
    (tmp_path / "00000003_depth.pfm").write_bytes(b"broken")
    (tmp_path / "00000003_confidence.pfm").write_bytes(pfm(1.0))
    maps = pictures.read_depth(spark, str(tmp_path))
    assert [(r.frame_id, r.width, r.height) for r in maps.collect()] == [(1, 4, 3)]
    kp = spark.createDataFrame([(1, 0, 960.0, 720.0), (9, 0, 1.0, 1.0)], "frame_id bigint, idx int, x float, y float")
    fr = spark.createDataFrame([(1, K9, np.eye(4).ravel(order="F").tolist())], "id bigint, intrinsics array<double>, extrinsics array<double>")
    got = {r.frame_id: r for r in pictures.at_keypoints(maps, kp, fr).collect()}
    assert got[1].depth == 2 and got[1].depth_confidence == 100 and got[1].normal == pytest.approx([0, 0, 1]) and got[9].depth is None


def test_model_to_refined_map(spark):
    x, _, poses = scene(60, 4)
    rng = np.random.default_rng(9)
    eye = np.eye(4).ravel(order="F").tolist()
    none = lambda s: spark.createDataFrame([], s)
    fr = spark.createDataFrame([(i, 10 * i, K9, p.ravel(order="F").tolist()) for i, p in enumerate(poses)], "id bigint, timestamp bigint, intrinsics array<double>, extrinsics array<double>")
    s = Session(
        fr, none("timestamp bigint, relative array<double>, global array<double>, accuracy array<double>"),
        none("id bigint, x double, y double, z double, orientation array<float>, desc binary, sightings int, lx double, lz double, ux double, uz double, last_seen bigint"),
        spark.createDataFrame([(0, 1, eye, eye)], "id bigint, frame_id bigint, transform array<double>, relative_transform array<double>"), none("src bigint, dst bigint"),
        spark.createDataFrame([(False, eye)], "origin_ready boolean, origin array<double>"),
    )
    off = x + rng.normal(0, 0.03, x.shape)
    points = spark.createDataFrame([(j + 1, float(v[0]), float(-v[1]), float(-v[2]), [(i + 1, j) for i in range(4)]) for j, v in enumerate(off)], "point_id bigint, x double, y double, z double, track array<struct<image_id:int,point_idx:int>>")
    uv = [localize.project(se3.flip_np(p), x, K)[0] for p in poses]
    kp = spark.createDataFrame([(i + 1, j, float(uv[i][j, 0]), float(uv[i][j, 1]), 4.0, 0.0) for i in range(4) for j in range(60)], "image_id int, idx int, x float, y float, size float, angle float")
    desc = spark.createDataFrame([(1, j, bytes(128)) for j in range(60)], "image_id int, idx int, desc binary")
    images = spark.createDataFrame([(i + 1, f"0000000{i}_image.jpeg", *[None] * 7) for i in range(4)], "image_id int, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    full, obs = pipeline.with_model(s, points, images, kp, desc)
    assert full.landmarks.count() == 60 and obs.count() == 240
    out = pipeline.refined(full, obs, images, rounds=((5, 7.378),), pose_iterations=2, last=(3, 3.841), buckets=2)
    rows = sorted(out.landmarks.collect(), key=lambda r: r.id)
    got = np.array([(r.x, r.y, r.z) for r in rows])
    d = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
    assert np.abs(d(got) / d(x).clip(1e-9) - 1)[~np.eye(60, dtype=bool)].mean() < np.abs(d(off) / d(x).clip(1e-9) - 1)[~np.eye(60, dtype=bool)].mean()
    assert {r.sightings for r in rows} <= {3, 4} and out.anchors.first().transform == pytest.approx([r for r in out.frames.collect() if r.id == 1][0].extrinsics)
    assert pipeline.saved(out).landmarks.count() >= 55
