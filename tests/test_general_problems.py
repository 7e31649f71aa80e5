"""Points near points and regions, implausible spikes, orphan references: against brute force, with dirty input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakite.operators import near, orphans, spikes
from terrakite.operators.kdtree import LocalTree, Splits, box_of_rect, unit_vectors


def brute_near(rows, r):
    at = {(k, x + 0.0, z + 0.0) for k, x, z in rows if None not in (k, x, z) and np.isfinite([x, z]).all()}
    return {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(at, 2) if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r}


def cloud(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 3), rng.gauss(0, 30)) for i in range(n)]
    rows += [(1000 + i, 1.5, -2.0) for i in range(30)]  # a crowd on one spot
    rows += rows[:20]  # copies
    return rows + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, 1.0, float("inf")), (None, 0.0, 0.0), (2003, -0.0, 0.0), (2004, 0.0, -0.0)]


SCHEMA = "id bigint, x double, z double, k string, leaf string"


@pytest.mark.parametrize("leaf", [40_000, 25])
def test_near_and_inside(spark, leaf):
    rows = cloud(400, 1)
    pts = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    rects = [(1, (-5.0, -5.0), (5.0, 5.0)), (1, (-5.0, -5.0), (5.0, 5.0)), (2, (1.5, -2.0), (1.5, 50.0)), (3, (3.0, 3.0), (1.0, 9.0)), (4, None, (1.0, 1.0)), (5, (-1e9, -1e9), (1e9, 1e9)), (6, (0.0, 0.0), (0.0, 0.0))]
    rd = spark.createDataFrame(rects, "rect_id bigint, lower struct<x:double,y:double>, upper struct<x:double,y:double>")
    got = [tuple(r) for r in near.near_and_inside(pts, "id", "x", "z", 0.8, near.rect_rings(rd, "rect_id", "lower", "upper"), leaf_points=leaf).collect()]
    assert len(got) == len(set(got))
    assert {(a, b) for k, a, b in got if k == "near"} == brute_near(rows, 0.8)
    good = {(k, x, z) for k, x, z in rows if None not in (k, x, z) and np.isfinite([x, z]).all()}
    held = {(i, k) for i, lo, hi in rects if lo and hi and lo[0] <= hi[0] for k, x, z in good if lo[0] <= x <= hi[0] and lo[1] <= z <= hi[1]}
    assert {(a, b) for k, a, b in got if k == "inside"} == held


def test_near_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    rings = near.rect_rings(spark.createDataFrame([], "rect_id bigint, lower struct<x:double,y:double>, upper struct<x:double,y:double>"), "rect_id", "lower", "upper")
    assert near.near_and_inside(none, "id", "x", "z", 1.0, rings).collect() == []
    assert near.near_and_inside(none, "id", "x", "z", 1.0).collect() == []


def test_sweep_over_a_polygon_with_a_notch():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    ax, az = np.array(ring, float).T
    bx, bz = np.roll(ax, -1), np.roll(az, -1)
    px, pz = np.array([1.0, 2.0, 2.0, 3.9, 2.0, 0.0, 5.0, 4.0]), np.array([1.0, 0.5, 2.0, 3.0, 1.0, 2.0, 1.0, 2.0])
    r, p = near.sweep(px, pz, np.full(5, 7), ax, az, bx, bz)
    assert sorted(p.tolist()) == [0, 1, 3, 4, 5, 7] and set(r.tolist()) == {7}


def test_points_on_the_globe(spark):
    pts = spark.createDataFrame([(1, 179.99999, 0.0), (2, -179.99999, 0.0), (3, 0.0, 89.99999), (4, 180.0, 89.99999), (5, 10.0, 10.0)], "id bigint, x double, z double")
    got = {(r.first_key, r.second_key) for r in near.near_and_inside(pts, "id", "x", "z", 3.0, kind="sphere", leaf_points=2).collect()}
    assert got == {(1, 2), (3, 4)}


def test_trees():
    v = unit_vectors(*np.random.default_rng(0).normal(0, 1e6, (2, 500)))
    want = {(i, j) for i, j in itertools.combinations(range(500), 2) if np.linalg.norm(v[i] - v[j]) <= 0.05}
    got = [tuple(sorted(p)) for a, b in LocalTree(v).pairs(0.05, chunk=7) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    s = Splits.fit(v, 4)
    row, leaf = s.place(v, v)
    assert (s.home(v)[row] == leaf).all() and len(row) == 500
    lo, hi = box_of_rect(np.array([-1e6]), np.array([-2e6]), np.array([3e6]), np.array([1e6]))
    w = unit_vectors(np.random.default_rng(1).uniform(-1e6, 3e6, 300), np.random.default_rng(2).uniform(-2e6, 1e6, 300))
    assert (w >= lo).all() and (w <= hi).all()


GPS = "gps_id bigint, session_id bigint, relative array<double>, global array<double>, accuracy array<double>, source string"


def walk(n, session, first, seed, noise=1e-6):
    rng = np.random.default_rng(seed)
    x, z = np.cumsum(rng.normal(1, 0.2, n)), np.cumsum(rng.normal(0.3, 0.2, n))
    a = 0.7
    lat = 40 + (np.sin(a) * x - np.cos(a) * z) / 110_574 + rng.normal(0, noise, n)
    lon = 9 + (np.cos(a) * x + np.sin(a) * z) / (111_320 * np.cos(np.radians(40))) + rng.normal(0, noise, n)
    return [[first + i, session, [float(x[i]), 0.0, float(z[i])], [float(lat[i]), float(lon[i]), 50 + float(rng.normal(0, 0.1))], [5.0, 5.0, -1.0], "s"] for i in range(n)]


@pytest.mark.parametrize("chunk", [8192, 120])
def test_spikes(spark, chunk):
    rows = walk(600, 1, 10_000, 1) + walk(40, 2, 20_000, 2)
    by = {r[0]: r for r in rows}
    want = {}
    by[10_050][3][0] += 0.001; want[10_050] = "spike"  # noqa: E702
    for k in (10_118, 10_119, 10_120):
        by[k][3][1] -= 0.002; want[k] = "spike"  # noqa: E702
    for k in range(10_200, 10_206):
        by[k][3][0] += 0.001  # too long to be a spike
    by[10_260][3][2] += 30; want[10_260] = "spike"  # noqa: E702
    by[10_270][4] = [60.0, 60.0, 1.0]; want[10_270] = "spike"  # noqa: E702
    for k in range(10_280, 10_285):
        by[k][4] = [60.0, 60.0, 1.0]  # too long to be a spike
    for k in range(10_356, 10_364):
        by[k][3] = by[10_355][3]; want[k] = "stuck"  # noqa: E702
    for k in range(10_401, 10_405):
        by[k][3] = by[10_400][3]; by[k][2] = by[10_400][2]  # stuck, but standing still  # noqa: E702
    by[10_450][3] = [91.0, 0.0, 50.0]; want[10_450] = "impossible"  # noqa: E702
    by[10_451][3] = [0.0, 0.0, 50.0]; want[10_451] = "impossible"  # noqa: E702
    by[10_452][3] = [float("nan"), 1.0, 50.0]; want[10_452] = "impossible"  # noqa: E702
    by[10_453][4] = [0.0, 5.0, 5.0]; want[10_453] = "impossible"  # noqa: E702
    by[10_454][4] = [2e6, 5.0, 5.0]; want[10_454] = "impossible"  # noqa: E702
    by[10_455][3] = None
    by[10_456][3] = [by[10_456][3][0], by[10_456][3][1], None]
    by[10_457][4] = None
    rows = list(by.values()) + [by[10_050]] * 3 + [[30_000, None, [0.0, 0.0, 0.0], [95.0, 0.0, 0.0], None, "s"], [30_001, None, None, None, None, "s"], [None, 1, None, [95.0, 0.0, 0.0], None, "s"], [30_002, 3, None, [40.0, 9.0, 1.0], [5.0, 5.0, 1.0], "s"]]
    want[30_000] = "impossible"
    got = [tuple(r) for r in spikes.implausible_fixes(spark.createDataFrame(rows, GPS), chunk_rows=chunk, halo=40 if chunk < 1000 else 512).collect()] if chunk > 1000 else [tuple(r) for r in _small_chunks(spark, rows, chunk)]
    assert sorted(got) == sorted(want.items())


def _small_chunks(spark, rows, chunk):
    old = spikes.ordered_chunks
    spikes.ordered_chunks = lambda *a, **k: old(*a, **k, bin_width=16)
    try:
        return spikes.implausible_fixes(spark.createDataFrame(rows, GPS), chunk_rows=chunk, halo=40).collect()
    finally:
        spikes.ordered_chunks = old


def test_a_stuck_run_over_several_chunks_is_judged_whole(spark):
    rows = walk(1000, 1, 10_000, 7) + walk(1000, 2, 20_000, 8) + walk(300, 3, 30_000, 9)
    by = {r[0]: r for r in rows}
    for first in (10_100, 20_100):
        for k in range(first + 1, first + 700):
            by[k][3] = by[first][3]
    for k in range(10_101, 10_650):
        by[k][2] = by[10_100][2]  # parked first, then moving
    for k in range(20_150, 20_800):
        by[k][2] = by[20_150][2]  # moving first, then parked
    for k in range(30_101, 30_300):
        by[k][3], by[k][2] = by[30_100][3], by[30_100][2]  # standing still
    got = sorted(r.gps_id for r in _small_chunks(spark, rows, 120) if r.reason == "stuck")
    assert got == [*range(10_101, 10_800), *range(20_101, 20_800)]


def test_a_spike_in_a_chunk_noisier_than_its_session_is_found(spark):
    rows = walk(1600, 1, 10_240, 5)
    by = {r[0]: r for r in rows}
    for k in range(11_200, 11_500):
        by[k][4] = [40.0, 40.0, 1.0]  # eight times the usual
    by[11_300][4] = [55.0, 40.0, 1.0]
    got = {r.gps_id for r in _small_chunks(spark, rows, 120) if r.reason == "spike"}
    assert 11_300 in got


@pytest.mark.parametrize("chunk", [8192, 120])
def test_spikes_close_together_neither_hide_each_other_nor_what_is_between(spark, chunk):
    rows = walk(600, 1, 10_000, 11)
    by = {r[0]: r for r in rows}
    want = [10_000 + k for k in range(7) if k != 3] + [10_200 + k for k in range(11) if k % 4 < 3] + [10_400 + k for k in range(24) if k % 3 < 2] + [10_593 + k for k in range(7) if k != 3]
    for k in want:
        by[k][3][2 if 10_400 <= k < 10_500 else 0] += 40 if 10_400 <= k < 10_500 else 0.001
    for k in (*range(10_300, 10_305), *range(10_308, 10_313)):
        by[k][3][1] += 0.001  # too long to be spikes, and the three between are where they should be
    got = spikes.implausible_fixes(spark.createDataFrame(rows, GPS)).collect() if chunk > 1000 else _small_chunks(spark, rows, chunk)
    assert sorted(tuple(r) for r in got) == [(k, "spike") for k in want]


def test_residuals_at_steps_and_slow_changes():
    v = np.random.default_rng(3).normal(0, 0.1, 600)
    usual, axes = np.median(np.abs(v)), (0.8, 0.4, 0.4)
    for slope in (0.0, 0.05, 0.15, 0.5):
        for n in (8, 12, 60, 400):  # a step there and, but for the last, back
            x = v + slope * np.arange(600)
            x[200 : 200 + n] += 100
            over = np.abs(spikes.settled_residuals(x, axes)) >= 10 * usual
            assert not spikes.short_runs(np.ones(len(over), bool), over).any()
    out = np.zeros(600, bool)
    out[100 : 100 + spikes.LONGEST_BURST + 1] = out[: spikes.WINDOW + 1] = True
    assert np.array_equal(spikes.residuals_without(v, out), v - spikes.local_median(v))


def test_spikes_empty(spark):
    assert spikes.implausible_fixes(spark.createDataFrame([], GPS)).collect() == []


def test_phase_space_with_given_axes_and_complex_residuals():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, 400) + 1j * rng.normal(0, 1, 400)
    z[[50, 51, 300]] = [40, -35j, 60 + 10j]
    usual = float(np.median(np.abs(z)))
    lam = 1.4826 * np.sqrt(2 * np.log(400))
    d1, d2 = spikes.differences(z)
    hit = spikes.phase_space_outliers(z, axes=(lam * usual, lam * np.median(np.abs(d1)), lam * np.median(np.abs(d2))))
    assert hit[[50, 51, 300]].all() and hit.sum() < 30
    one = np.array([12.0])
    assert spikes.phase_space_outliers(one, axes=(1.0, 0.0, 0.0)).all() and not spikes.phase_space_outliers(np.array([0.5]), axes=(1.0, 0.0, 0.0)).any()


def test_phase_space():
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, 500)
    v[[100, 300]] = [40, -25]
    hit = np.flatnonzero(spikes.phase_space_outliers(v))
    assert {100, 300} <= set(hit.tolist()) and len(hit) < 40
    assert not spikes.phase_space_outliers(np.zeros(100)).any() and not spikes.phase_space_outliers(np.zeros(2)).any()


T = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"


def test_orphans(spark):
    ts = lambda rows, s: spark.createDataFrame(rows, s).withColumn("received_at", F.to_timestamp_ntz("received_at"))
    frames = ts([(1, T(1, 1), None), (1, T(5, 1), None), (2, T(1, 1), T(2, 1)), (3, T(9, 1), None), (None, T(1, 1), None)], "id bigint, received_at string, deleted_at string")
    refs = ts([(10, 1, T(2, 2)), (11, 2, T(2, 2)), (12, 3, T(2, 3)), (12, 3, T(9, 3)), (13, 4, T(3, 2)), (14, None, T(3, 2)), (15, -1, T(3, 2)), (16, 4, None), (None, 4, T(1, 1))], "id bigint, frame_id bigint, received_at string")
    got = {tuple(r) for r in orphans.checked(orphans.references(refs, "anchors", "id", "frame_id"), orphans.parents(frames, "id")).collect()}
    assert got == {("anchors", 10, 1, "ok", "2024-01-02"), ("anchors", 11, 2, "deleted", "2024-01-02"), ("anchors", 12, 3, "late", "2024-01-02"), ("anchors", 13, 4, "missing", "2024-01-03"), ("anchors", 16, 4, "missing", None)}
    assert orphans.checked(orphans.references(refs.limit(0), "a", "id", "frame_id"), orphans.parents(frames, "id")).collect() == []
    assert {r.state for r in orphans.checked(orphans.references(refs, "a", "id", "frame_id"), orphans.parents(frames.limit(0), "id")).collect()} == {"missing"}
