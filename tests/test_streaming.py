import numpy as np
import pytest

from terrakite.functions import se3
from terrakite.operators.localize import project
from terrakite.streaming import locations, tracker
from terrakite.streaming.config import TrackerConfig
from terrakite.streaming.filters import FILTERS, make_filter
from terrakite.streaming.measurement import DETECTORS, ESTIMATORS, Measurement

K = [800.0, 0.0, 0.0, 0.0, 800.0, 0.0, 320.0, 240.0, 1.0]
MAP_FROM_DEVICE = se3.rigid_np(se3.rotation_np([0, 0.4, 0]), [3, 0, -2])
RNG = np.random.default_rng(0)
CLOUD = np.stack([RNG.uniform(-6, 6, 40), RNG.uniform(-2, 2, 40), RNG.uniform(-12, -6, 40)], 1)


def device_pose(i):
    return se3.rigid_np(se3.rotation_np([0, 0.01 * i, 0]), [0.1 * i, 0, 0.02 * i])


def seen(pose, n=40):
    uv, z = project(se3.flip_np(pose), CLOUD[:n] @ MAP_FROM_DEVICE[:3, :3].T + MAP_FROM_DEVICE[:3, 3], (800, 800, 320, 240))
    w = CLOUD[:n] @ MAP_FROM_DEVICE[:3, :3].T + MAP_FROM_DEVICE[:3, 3]
    return [(*map(float, p), *map(float, q), 4.0, 0.02, 1) for p, q, d in zip(w, uv, z) if d > 0]


def flat(m):
    return m.ravel(order="F").tolist()


def events(n=12, device=1, bad=()):
    rows = []
    for i in range(n):
        t = 100_000 * i
        rows.append((device, 2 * i, t, "vio", flat(device_pose(i)), None, None, None, None))
        if i % 3 == 2:
            pose = MAP_FROM_DEVICE @ device_pose(i)
            if i in bad:
                pose = se3.rigid_np(np.eye(3), [50, 0, 0]) @ pose
            rows.append((device, 2 * i + 1, t, "located", flat(pose), t, 60, K, seen(MAP_FROM_DEVICE @ device_pose(i))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, tracker.EVENT)


def by_seq(df):
    return {(r.device, r.seq): r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_every_filter_finds_the_transform(spark, name):
    config = TrackerConfig(filter_strategy=name)
    junk = [(1, 90, None, "located", None, None, None, None, None), (None, 1, 1, "vio", flat(np.eye(4)), None, None, None, None), (1, 91, 5, "other", None, None, None, None, None), (1, 92, 6, "vio", [1.0] * 16, None, None, None, None)]
    got = by_seq(tracker.track(frame(spark, events() + junk), config))
    last = got[1, 23]
    want = se3.inverse_np(MAP_FROM_DEVICE)
    assert last.success and last.confidence > 0.3
    assert np.array(last.map_to_device).reshape(4, 4, order="F") == pytest.approx(want, abs=0.05)
    assert got[1, 0].uncertainty == float("inf") and not got[1, 92].success and np.isfinite(last.uncertainty)


def test_outliers_and_restart(spark):
    config = TrackerConfig(filter_strategy="kalman", outlier_detector="distance")
    got = by_seq(tracker.track(frame(spark, events(15, bad=(5,))), config))
    assert got[1, 11].outlier and got[1, 11].streak == 1 and got[1, 11].map_to_device == got[1, 5].map_to_device
    assert got[1, 17].streak == 0 and not got[1, 17].outlier
    got = by_seq(tracker.track(frame(spark, events(15, bad=(5, 8, 11))), TrackerConfig(filter_strategy="kalman", outlier_detector="distance", confidence_estimator="simple")))
    assert [got[1, k].streak for k in (11, 17, 23)] == [1, 2, 3] and got[1, 23].restarted and not got[1, 23].outlier


def test_late_measurements_are_carried_forward(spark):
    rows = [r for r in events(9) if r[3] == "vio"]
    rows.append((1, 99, 800_000, "located", flat(MAP_FROM_DEVICE @ device_pose(3)), 300_000, 60, K, seen(MAP_FROM_DEVICE @ device_pose(3))))
    r = by_seq(tracker.track(frame(spark, rows), TrackerConfig()))[1, 99]
    assert np.array(r.map_to_device).reshape(4, 4, order="F") == pytest.approx(se3.inverse_np(MAP_FROM_DEVICE), abs=1e-9)


def stream(spark, tmp_path, batches, schema, run, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = run(df).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = events(9) + events(9, device=2, bad=(5,))
    config = TrackerConfig(filter_strategy="averaging")
    cut = [[r for r in rows if lo <= r[2] < lo + 300_000] for lo in (0, 300_000, 600_000)]
    got = by_seq(stream(spark, tmp_path, cut, tracker.EVENT, lambda d: tracker.track_stream(d, config), "tracked"))
    want = by_seq(tracker.track(frame(spark, rows), config))
    assert set(got) == set(want)
    for k in want:
        assert got[k].success == want[k].success and got[k].streak == want[k].streak and got[k].map_to_device == want[k].map_to_device


CASES = [
    ([("location", 2, 10), ("position", 1, 1), ("position", 5, 10)], [(2, 3.25)]),
    ([("location", 2, 10), ("position", 10, 1), ("position", 14, 10), ("location", 11, 5)], [(11, 3.25)]),
    ([("position", 0, -1), ("position", 10, 1), ("location", 11, 10), ("position", 14, 10)], [(11, 3.25)]),
    ([("location", 11, 10), ("position", 0, -1), ("position", 10, 1), ("location", 13, 5), ("position", 14, 10)], [(11, 3.25), (13, 7.75)]),
    ([("location", 11, 10), ("position", 0, -1), ("position", 10, 1)], []),
    ([("location", 1, 10), ("position", 1, 1), ("position", 1, 10)], [(1, 5.5)]),
    ([("location", 0, 10), ("position", 1, 1), ("position", 1, 10)], []),
    ([("location", 2, 10), ("position", 1, 1), ("position", 1, 10)], []),
]


@pytest.mark.parametrize("case,want", CASES)
def test_matcher(case, want):
    m, out = locations.Matcher(), []
    for kind, t, v in case:
        out += m.position(t, (float(v), 0.0, 0.0)) if kind == "position" else m.location(t, (0.0, 0.0, 0.0), (float(v),) * 3)
    assert [(r[0], r[1]) for r in out] == want


def test_matching_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, kind, t, float(v), 0.0, 0.0, 1.0, 1.0, 1.0) for s, (case, _) in enumerate(CASES) for i, (kind, t, v) in enumerate(case)]
    df = spark.createDataFrame(rows, locations.EVENT)
    want = sorted((r.session_id, r.t, r.rel_x) for r in locations.match(df).collect())
    assert want == sorted((s, *w) for s, (_, ws) in enumerate(CASES) for w in ws)
    cut = [[r for r in rows if r[1] < 2], [r for r in rows if r[1] >= 2]]
    got = stream(spark, tmp_path, cut, locations.EVENT, locations.match_stream, "located")
    assert sorted((r.session_id, r.t, r.rel_x) for r in got.collect()) == want


def measurement(n=40):
    pose = MAP_FROM_DEVICE @ device_pose(0)
    return Measurement(pose, np.array(seen(pose, n)).reshape(-1, 8), 60, (800.0, 800.0), (320.0, 240.0))


@pytest.mark.parametrize("name", sorted(ESTIMATORS))
def test_confidence_grows_with_inliers(name):
    c, e = TrackerConfig(), ESTIMATORS[name]()
    few, many = measurement(5), measurement(40)
    assert 0 <= e.confidence(few, c) <= e.confidence(many, c) <= 1
    for m in (few, many, Measurement(np.eye(4), np.zeros((0, 8)), 0, (1.0, 1.0), (0.0, 0.0))):
        m.confidence = e.confidence(m, c)
        r = e.noise(m, c)
        assert r.shape == (6, 6) and np.allclose(r, r.T) and (np.diag(r) > 0).all()
    assert np.trace(e.noise(few, c)) >= np.trace(e.noise(many, c))


def test_detectors():
    c, z = TrackerConfig(), np.eye(4)
    far = se3.rigid_np(np.eye(3), [3.0, 0, 0])
    assert DETECTORS["distance"]().outlier(far, z, np.eye(6), 1, c) and not DETECTORS["distance"]().outlier(z, z, np.eye(6), 1, c)
    assert DETECTORS["chi_squared"]().outlier(far, z, np.eye(6), 1, c) and not DETECTORS["chi_squared"]().outlier(far, z, np.eye(6), 0.2, c)
    assert DETECTORS["confidence"]().outlier(z, z, np.eye(6), 0.2, c) and not DETECTORS["confidence"]().outlier(z, z, np.eye(6), 0.3, c)


def test_anchors_hold_the_rotation():
    c = TrackerConfig(enable_anchor_constraints=True)
    f = make_filter("kalman")
    m = measurement()
    m.confidence, m.noise, m.t = 0.9, np.eye(6) * 0.01, 0.0
    f.start(m, c)
    f.update_with_anchors(m, c)
    assert len(f.held) == 1
    f.x[3:] += [0, 0.05, 0]
    before, spread = f.x[4], f.p[4, 4]
    weak = measurement()
    weak.pose, weak.confidence, weak.noise, weak.t = se3.pose_matrix(f.x), 0.1, np.eye(6) * 1e6, 1.0
    f.update_with_anchors(weak, c)
    assert f.x[4] < before and f.p[4, 4] < spread and len(f.held) == 1


def test_settings():
    assert make_filter("unknown").__class__.__name__ == "SlidingWindow"
    for bad in ({"outlier_threshold": 0}, {"min_inliers_for_tracking": 2}, {"far_threshold": 5.0}, {"smooth_filter_alpha": 1.5}, {"anchor_max_count": 0}):
        with pytest.raises(ValueError):
            TrackerConfig(**bad)
    assert TrackerConfig(time_position_noise_scale=0.0).problems() == []


def test_empty(spark):
    assert tracker.track(frame(spark, [])).collect() == []
    assert locations.match(spark.createDataFrame([], locations.EVENT)).collect() == []
