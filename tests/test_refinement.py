import numpy as np
import pandas as pd
import pytest

from terrakite.functions import se3
from terrakite.operators import bundle, localize, sift

K = (800.0, 800.0, 320.0, 240.0)


def scene(n_frames=5, n_points=60, seed=0):
    """Device poses looking along -z at a cloud of points, and exact pixels."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.uniform(-4, 4, n_points), rng.uniform(-3, 3, n_points), rng.uniform(-14, -8, n_points)], 1)
    poses = [se3.rigid_np(se3.rotation_np(rng.normal(0, 0.03, 3)), np.array([0.5 * i, 0.05 * i, 0.0])) for i in range(n_frames)]
    uv = [localize.project(se3.flip_np(p), x, K)[0] for p in poses]
    return x, poses, uv


def tables(spark, x, poses, uv, noise=0.3, off=0.05, seed=1):
    rng = np.random.default_rng(seed)
    k = [K[0], 0.0, 0.0, 0.0, K[1], 0.0, K[2], K[3], 1.0]
    frames = spark.createDataFrame([(i, k, p.ravel(order="F").tolist()) for i, p in enumerate(poses)], "id bigint, intrinsics array<double>, extrinsics array<double>")
    start = {i: p @ se3.rigid_np(se3.rotation_np(rng.normal(0, off / 10, 3)), rng.normal(0, off, 3)) for i, p in enumerate(poses)}
    lm = spark.createDataFrame([(100 + j, *map(float, v + rng.normal(0, off, 3)), 5) for j, v in enumerate(x)] + [(999, 0.0, 0.0, 0.0, 1)], "id bigint, x double, y double, z double, sightings int")
    obs = [(100 + j, i, float(uv[i][j, 0] + rng.normal(0, noise)), float(uv[i][j, 1] + rng.normal(0, noise)), 1 << 8) for i in range(len(poses)) for j in range(len(x))]
    for n in range(0, len(obs), 37):
        obs[n] = (*obs[n][:2], obs[n][2] + 60, obs[n][3], obs[n][4])  # gross errors
    o = spark.createDataFrame(obs + [(999, 0, 1.0, 1.0, 256)], "landmark_id bigint, frame_id bigint, u double, v double, octave int")
    return frames, lm, o, start, len(range(0, len(obs), 37))


def test_refinement_lowers_the_error_and_culls(spark):
    x, poses, uv = scene()
    frames, lm, obs, start, gross = tables(spark, x, poses, uv)
    r = bundle.refine(frames, lm, obs, start, rounds=((6, 7.378), (4, 5.991)), pose_iterations=4, last=(4, 5.991), buckets=3)
    assert r.before > 4 and r.after < 0.6
    culled = r.errors.where("level > 0").count()
    assert gross <= culled <= gross + 15
    dev = bundle.device_poses(r.cameras)
    assert max(np.linalg.norm(dev[i][:3, 3] - dev[0][:3, 3] - poses[i][:3, 3] + poses[0][:3, 3]) for i in range(5)) < 0.2
    assert len(r.cameras.fixed) == 1 and r.errors.where("landmark_id = 999").count() == 0
    twice = bundle.rescaled(r.cameras, 2.0, 0)
    assert np.linalg.norm(bundle.device_poses(twice)[1][:3, 3] - dev[0][:3, 3]) == pytest.approx(2 * np.linalg.norm(dev[1][:3, 3] - dev[0][:3, 3]))
    assert bundle.rescaled(r.cameras, 0.0, 0) is r.cameras


def test_elimination_equals_the_whole_system():
    x, poses, uv = scene(3, 12)
    rng = np.random.default_rng(3)
    cams = bundle.Cameras({i: bundle.exp_se3(rng.normal(0, 0.01, 6)) @ se3.flip_np(p) for i, p in enumerate(poses)}, {i: (K[0], K[2], K[3]) for i in range(3)})
    df = pd.DataFrame([(j, i, *x[j], *uv[i][j], 1.0, 0) for i in range(3) for j in range(12)], columns=["landmark_id", "frame_id", "x", "y", "z", "u", "v", "info", "level"])
    jc, jl, e, w, cost = bundle._normal(cams, df)
    full, rhs = np.zeros((18 + 36, 18 + 36)), np.zeros(54)
    for n in range(len(df)):
        f, l = df.frame_id[n], df.landmark_id[n]  # noqa: E741
        j = np.zeros((2, 54))
        j[:, 6 * f : 6 * f + 6], j[:, 18 + 3 * l : 21 + 3 * l] = jc[n], jl[n]
        full += w[n] * j.T @ j
        rhs -= w[n] * j.T @ e[n]
    full[18:, 18:] += 1e-9 * np.eye(36)
    c2, h, b, back = bundle.eliminate(cams, df, 0.0, True)
    a, d = full[:18, :18], full[18:, 18:]
    s = a - full[:18, 18:] @ np.linalg.solve(d, full[18:, :18])
    assert c2 == pytest.approx(cost)
    got = np.zeros((18, 18))
    for (i, k), v in h.items():
        got[6 * i : 6 * i + 6, 6 * k : 6 * k + 6] = v
    assert got == pytest.approx(s, rel=1e-6, abs=1e-3)
    assert np.concatenate([b[i] for i in range(3)]) == pytest.approx(rhs[:18] - full[:18, 18:] @ np.linalg.solve(d, rhs[18:]), rel=1e-6, abs=1e-3)
    dc = rng.normal(0, 1e-3, 18)
    points = back({i: dc[6 * i : 6 * i + 6] for i in range(3)})
    assert np.concatenate([points[j] for j in range(12)]) == pytest.approx(np.linalg.solve(d, rhs[18:] - full[18:, :18] @ dc), rel=1e-5, abs=1e-6)


def test_large_systems_are_solved_as_small_ones():
    rng = np.random.default_rng(0)
    n = 30
    m = rng.normal(size=(6 * n, 6 * n))
    m = m @ m.T + 50 * np.eye(6 * n)
    h = {(i, j): m[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] for i in range(n) for j in range(n)}
    b = {i: rng.normal(size=6) for i in range(n)}
    small = bundle.solve_cameras(h, b, {3}, 0.0)
    old, bundle.DENSE_FRAMES = bundle.DENSE_FRAMES, 0
    try:
        large = bundle.solve_cameras(h, b, {3}, 0.0)
    finally:
        bundle.DENSE_FRAMES = old
    assert set(small) == set(large) == set(range(n)) - {3}
    assert np.stack([large[i] for i in small]) == pytest.approx(np.stack(list(small.values())), abs=1e-6)


def test_se3_maps():
    for s in range(5):
        v = np.random.default_rng(s).normal(0, 0.8, 6)
        assert bundle.log_se3(bundle.exp_se3(v)) == pytest.approx(v, abs=1e-9)
    assert bundle.exp_se3(np.zeros(6)) == pytest.approx(np.eye(4))


def test_localize(spark):
    x, poses, uv = scene(3, 80)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3):
        p = uv[i] + rng.normal(0, 0.5, uv[i].shape)
        p[::3] = rng.uniform(0, 640, (len(p[::3]), 2))
        rows += [(i, 100 + j, j, *map(float, x[j]), *map(float, p[j])) for j in range(80)]
    rows += [(7, 1, 0, 0.0, 0.0, -9.0, 1.0, 1.0)] * 3
    m = spark.createDataFrame(rows, "frame_id bigint, landmark_id bigint, position int, x double, y double, z double, u double, v double")
    k = [K[0], 0.0, 0.0, 0.0, K[1], 0.0, K[2], K[3], 1.0]
    g = [se3.flip_np(p)[:3, :3] @ np.array([0, -1.0, 0]) for p in poses]
    g[2] = g[2] + np.array([0.3, 0, 0])
    fr = spark.createDataFrame([(i, k, g[i].tolist()) for i in range(3)] + [(7, k, None)], "frame_id bigint, intrinsics array<double>, gravity array<double>")
    got = {r.frame_id: r for r in localize.localize(m, fr, tries=400).collect()}
    assert [got[i].success for i in (0, 1, 2, 7)] == [True, True, False, False]
    for i in (0, 1, 2):
        assert np.array(got[i].pose).reshape(4, 4, order="F")[:3, 3] == pytest.approx(poses[i][:3, 3], abs=0.05)
        assert got[i].inliers >= 45
    assert got[7].pose is None and got[7].matches == 3 and got[2].gravity_degrees > 3


def blobs(shift=0):
    y, x = np.mgrid[0:96, 0:128].astype(float)
    img = np.full(y.shape, 60.0)
    for cx, cy, s, a in ((30, 30, 4, 150), (80, 60, 6, 120), (100, 25, 3, 170), (50, 70, 5, -50), (65, 30, 4, 90)):
        img += a * np.exp(-(((x - cx - shift) / 1.3) ** 2 + (y - cy) ** 2) / (2 * s * s))
    return np.clip(img, 0, 255).astype(np.uint8)


def test_features_follow_the_image(spark):
    k1, d1 = sift.detect_and_compute(blobs())
    k2, d2 = sift.detect_and_compute(blobs(6))
    assert len(k1) >= 5 and d1.shape == (len(k1), 128)
    near = np.linalg.norm(k1[:, None, :2] - np.array([[30, 30], [80, 60], [100, 25]])[None], axis=2).min(0)
    assert (near < 2).all()
    d = np.linalg.norm(d1[:, None].astype(float) - d2[None].astype(float), axis=2)
    moved = k2[d.argmin(1), :2] - k1[:, :2]
    good = d.min(1) < 100
    assert good.sum() >= 5 and np.median(moved[good], axis=0) == pytest.approx([6, 0], abs=0.5)
    img = blobs()
    rows = [(1, 128, 96, img.tobytes()), (2, 128, 96, b"short"), (3, 0, 0, b""), (4, 10, 10, bytes(100)), (5, 64, 64, bytes(4096)), (6, None, None, None)]
    df = spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")
    out = sift.extract(df).collect()
    assert {r.image_id for r in out} == {1} and len(out) == len(k1)


def test_tables_of_earlier_rounds_are_removed(spark):
    from terrakite.plans import stage

    x, poses, uv = scene()
    frames, lm, obs, start, _ = tables(spark, x, poses, uv)
    held = len(stage._written)
    r = bundle.refine(frames, lm, obs, start, rounds=((3, 7.378), (2, 5.991)), pose_iterations=2, last=(2, 5.991))
    assert len(stage._written) == held + 2 and r.errors.count() > 0 and r.points.count() == 60
    gone = stage.staged(lm, "gone")
    stage.discard(gone, lm, None)
    assert len(stage._written) == held + 2
