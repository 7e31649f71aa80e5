"""Refinement of camera poses and landmarks by robust least squares (Levenberg-Marquardt with a Schur complement).

Poses are world-to-camera (y down, z forward) and updated from the left.  The sums over observations
are made where the observations are: buckets of whole landmarks each eliminate their points and
return blocks of the reduced camera system, which are summed by pair of frames and solved on the
driver, densely for few frames, by block-preconditioned conjugate gradients for many.  The driver
holds poses and camera blocks, never landmarks or observations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.functions import camera, se3
from terrakite.operators.aggregates import USABLE_SIGHTINGS, most_connected_frame
from terrakite.plans.stage import arrow_groups, discard, staged

#: Kernel width, rounds of (iterations, outlier limit), odometry factor.
HUBER = 5.991**0.5
POSE_ITERATIONS = 50
BUCKET_ROWS = 50_000  # no fixed value: observations of a group
ROUNDS = ((300, 7.378), (100, 5.991), (60, 4.605), (60, 3.841))
LAST = (100, 3.841)
ODOMETRY_FACTOR = 2.3
DENSE_FRAMES = 400


def log_se3(m: np.ndarray) -> np.ndarray:
    """(rotation, translation) part of the logarithm."""
    w = se3.axis_angle_np(m[:3, :3])
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    inv = np.eye(3) - k / 2 + (0 if a < 1e-6 else (1 - a / (2 * np.tan(a / 2))) / a**2) * k @ k
    return np.concatenate([w, inv @ m[:3, 3]])


def exp_se3(v: np.ndarray) -> np.ndarray:
    w, a = v[:3], float(np.linalg.norm(v[:3]))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    left = np.eye(3) + (k / 2 if a < 1e-6 else (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k)
    return se3.rigid_np(se3.rotation_np(w), left @ v[3:])


@dataclass
class Cameras:
    """Poses by frame id, their focal length and centre, which are fixed, and edges between them."""

    poses: dict[int, np.ndarray]
    intrinsics: dict[int, tuple[float, float, float]]
    fixed: set[int] = field(default_factory=set)
    odometry: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # a, b, measured, information diagonal
    gravity: list[tuple[int, np.ndarray]] = field(default_factory=list)  # frame, direction in the camera

    def moved(self, step: dict[int, np.ndarray]) -> "Cameras":
        return Cameras({i: exp_se3(step[i]) @ p if i in step else p for i, p in self.poses.items()}, self.intrinsics, self.fixed, self.odometry, self.gravity)

    def edge_terms(self):
        """(cost, {(i, j): 6 x 6}, {i: 6}) of odometry and gravity edges, by central differences."""
        cost, h, b = 0.0, {}, {}
        eye = np.eye(6) * 1e-6

        def add(ids, f, info):
            nonlocal cost
            r = f(*[self.poses[i] for i in ids])
            js = []
            for n, i in enumerate(ids):
                at = lambda d: f(*[exp_se3(d) @ self.poses[k] if m == n else self.poses[k] for m, k in enumerate(ids)])  # noqa: B023
                js.append(np.stack([(at(e) - at(-e)) / 2e-6 for e in eye], 1))
            cost += float(r @ (info * r))
            for i, ji in zip(ids, js):
                b[i] = b.get(i, 0) - ji.T @ (info * r)
                for k, jk in zip(ids, js):
                    h[i, k] = h.get((i, k), 0) + ji.T @ (info[:, None] * jk)

        for i, k, m, info in self.odometry:
            add((i, k), lambda p, q: log_se3(se3.inverse_np(q) @ m @ p), info)  # noqa: B023
        down = np.array([0.0, -1.0, 0.0])
        for i, g in self.gravity:
            add((i,), lambda p: p[:3, :3].T @ down - g, np.ones(3))  # noqa: B023
        return cost, h, b

    def odometry_chi2(self) -> list[float]:
        out = []
        for i, k, m, info in self.odometry:
            r = log_se3(se3.inverse_np(self.poses[k]) @ m @ self.poses[i])
            out.append(float(r @ (info * r)))
        return out


def device_cameras(frames: list[tuple[int, list[float], list[float]]], fixed: int) -> Cameras:
    """Cameras, odometry and gravity edges from frames (id, intrinsics 9, extrinsics 16) in order of id; every frame but the last has a gravity edge."""
    frames = sorted(frames, key=lambda f: f[0])
    poses = {i: se3.flip_np(np.array(e, float).reshape(4, 4, order="F")) for i, _, e in frames}
    k = {i: (float(m[0]), float(m[6]), float(m[7])) for i, m, _ in frames}
    odometry = []
    for (a, *_), (b, *_) in zip(frames, frames[1:]):
        m = poses[b] @ se3.inverse_np(poses[a])
        s = 1 / max(0.1, float(np.linalg.norm(m[:3, 3])))
        # the first three of the error are the rotation here, the last three the translation
        odometry.append((a, b, m, np.repeat([s * s / np.radians(10.0) ** 2, s * s / 0.2**2], 3)))
    gravity = [(i, poses[i][:3, :3].T @ np.array([0.0, -1.0, 0.0])) for i, *_ in frames[:-1]]
    return Cameras(poses, k, {fixed}, odometry, gravity)


def _observed(cams: Cameras, df: pd.DataFrame):
    """Residuals (n x 2), chi2 and points in the camera of rows frame_id, x, y, z, u, v, info."""
    ids, inv = np.unique(df["frame_id"].to_numpy(), return_inverse=True)
    r = np.stack([cams.poses[i][:3, :3] for i in ids])[inv]
    t = np.stack([cams.poses[i][:3, 3] for i in ids])[inv]
    k = np.array([cams.intrinsics[i] for i in ids])[inv]
    c = np.einsum("nij,nj->ni", r, df[["x", "y", "z"]].to_numpy(float)) + t
    z = np.where(np.abs(c[:, 2]) < 1e-9, 1e-9, c[:, 2])
    e = k[:, :1] * c[:, :2] / z[:, None] + k[:, 1:] - df[["u", "v"]].to_numpy(float)
    return r, k[:, 0], c, z, e, df["info"].to_numpy(float) * (e * e).sum(1)


def _normal(cams: Cameras, df: pd.DataFrame):
    """Per observation: pose Jacobian (2 x 6), point Jacobian (2 x 3), error, weight; and the robust cost."""
    r, f, c, z, e, chi2 = _observed(cams, df)
    n = len(df)
    jp = np.zeros((n, 2, 3))
    jp[:, 0, 0] = jp[:, 1, 1] = f / z
    jp[:, 0, 2], jp[:, 1, 2] = -f * c[:, 0] / z**2, -f * c[:, 1] / z**2
    turn = np.zeros((n, 3, 6))
    turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 0], turn[:, 1, 2], turn[:, 2, 0], turn[:, 2, 1] = c[:, 2], -c[:, 1], -c[:, 2], c[:, 0], c[:, 1], -c[:, 0]
    turn[:, :, 3:] = np.eye(3)
    far = chi2 > HUBER**2
    root = np.sqrt(np.maximum(chi2, 1e-300))
    w = df["info"].to_numpy(float) * np.where(far, HUBER / root, 1.0)
    w = np.where(df["level"].to_numpy() > 0, 0.0, w)
    cost = float(np.where(df["level"].to_numpy() > 0, 0.0, np.where(far, 2 * HUBER * root - HUBER**2, chi2)).sum())
    return jp @ turn, jp @ r, e, w, cost


def eliminate(cams: Cameras, df: pd.DataFrame, damping: float, points_free: bool):
    """(cost, {(i, j): 6 x 6}, {i: 6}, back): the camera system of whole landmarks with their points eliminated, and how to get the points' steps."""
    df = df.sort_values("landmark_id", kind="stable")
    jc, jl, e, w, cost = _normal(cams, df)
    frames, fi = np.unique(df["frame_id"].to_numpy(), return_inverse=True)
    marks, li = np.unique(df["landmark_id"].to_numpy(), return_inverse=True)
    hcc = np.zeros((len(frames), 6, 6))
    np.add.at(hcc, fi, np.einsum("nki,n,nkj->nij", jc, w, jc))
    bc = np.zeros((len(frames), 6))
    np.add.at(bc, fi, -np.einsum("nki,n,nk->ni", jc, w, e))
    h = {(int(i), int(i)): hcc[n] for n, i in enumerate(frames)}
    if not points_free:
        return cost, h, {int(i): bc[n] for n, i in enumerate(frames)}, None
    hll, bl = np.zeros((len(marks), 3, 3)), np.zeros((len(marks), 3))
    np.add.at(hll, li, np.einsum("nki,n,nkj->nij", jl, w, jl))
    np.add.at(bl, li, -np.einsum("nki,n,nk->ni", jl, w, e))
    hll += np.einsum("nii->ni", hll)[:, :, None] * damping * np.eye(3) + 1e-9 * np.eye(3)
    inv = np.linalg.inv(hll)
    hcl = np.einsum("nki,n,nkj->nij", jc, w, jl)  # one an observation
    np.add.at(bc, fi, -np.einsum("nij,njk,nk->ni", hcl, inv[li], bl[li]))
    size = np.bincount(li, minlength=len(marks))
    begin = np.cumsum(size) - size
    a = np.repeat(np.arange(len(df)), size[li])  # every observation with every other of its landmark
    b = np.arange(len(a)) - np.repeat(np.cumsum(size[li]) - size[li], size[li]) + begin[li[a]]
    cross = -np.einsum("nij,njk,nlk->nil", hcl[a], inv[li[a]], hcl[b])
    code, at = np.unique(fi[a].astype(np.int64) * len(frames) + fi[b], return_inverse=True)
    total = np.zeros((len(code), 6, 6))
    np.add.at(total, at, cross)
    for n, k in enumerate(code):
        key = int(frames[k // len(frames)]), int(frames[k % len(frames)])
        h[key] = h.get(key, 0) + total[n]

    def back(step: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        d = np.stack([step.get(int(i), np.zeros(6)) for i in frames])[fi]
        g = bl.copy()
        np.add.at(g, li, -np.einsum("nij,ni->nj", hcl, d))
        return dict(zip(marks.tolist(), np.einsum("nij,nj->ni", inv, g)))

    return cost, h, {int(i): bc[n] for n, i in enumerate(frames)}, back


def solve_cameras(h: dict, b: dict, fixed: set[int], damping: float) -> dict[int, np.ndarray]:
    """Steps of the free cameras: dense for up to DENSE_FRAMES, else conjugate gradients with the diagonal blocks as preconditioner."""
    ids = sorted({i for i, _ in h} - fixed)
    at = {k: n for n, k in enumerate(ids)}
    n = len(ids)
    if not n:
        return {}
    blocks = {(at[i], at[j]): np.asarray(m, float) for (i, j), m in h.items() if i in at and j in at}
    for i in range(n):
        d = blocks.setdefault((i, i), np.zeros((6, 6)))
        blocks[i, i] = d + np.diag(np.abs(np.diag(d)) * damping + 1e-9)
    rhs = np.stack([b.get(k, np.zeros(6)) for k in ids])
    if n <= DENSE_FRAMES:
        m = np.zeros((n, 6, n, 6))
        for (i, j), v in blocks.items():
            m[i, :, j, :] = v
        x = np.linalg.lstsq(m.reshape(6 * n, 6 * n), rhs.ravel(), rcond=None)[0].reshape(n, 6)
        return {k: x[i] for k, i in at.items()}
    rows, cols = np.array(list(blocks)).T
    values = np.stack(list(blocks.values()))
    pre = np.linalg.inv(np.stack([blocks[i, i] for i in range(n)]))

    def times(v):
        out = np.zeros_like(v)
        np.add.at(out, rows, np.einsum("nij,nj->ni", values, v[cols]))
        return out

    x, r = np.zeros_like(rhs), rhs.copy()
    z = np.einsum("nij,nj->ni", pre, r)
    p, rz = z.copy(), float((r * z).sum())
    for _ in range(200):
        q = times(p)
        alpha = rz / max(float((p * q).sum()), 1e-300)
        x, r = x + alpha * p, r - alpha * q
        if np.linalg.norm(r) <= 1e-8 * np.linalg.norm(rhs):
            break
        z = np.einsum("nij,nj->ni", pre, r)
        new = float((r * z).sum())
        p, rz = z + new / rz * p, new
    return {k: x[i] for k, i in at.items()}


_BLOCKS = "i long, j long, cost double, h array<double>, b array<double>"


class Problem:
    """Observations (landmark_id, frame_id, u, v, info, level) and points (landmark_id, x, y, z) in Spark, cameras on the driver."""

    def __init__(self, cams: Cameras, observations: DataFrame, points: DataFrame, buckets: int | None = None):
        """`buckets`: groups of landmarks that are summed in one task; by default one for BUCKET_ROWS observations, at least one a core."""
        self.cams = cams
        self.obs = staged(observations.select("landmark_id", "frame_id", "u", "v", "info", F.lit(0).alias("level")), "observations")
        self.points = staged(points.select("landmark_id", "x", "y", "z"), "points")
        self.buckets = buckets or arrow_groups(observations.sparkSession, self.obs.count(), BUCKET_ROWS)

    def _rows(self, points: DataFrame) -> DataFrame:
        return self.obs.join(points, "landmark_id").withColumn("_b", F.pmod(F.xxhash64("landmark_id"), F.lit(self.buckets)))

    def system(self, cams: Cameras, points: DataFrame, damping: float, points_free: bool):
        def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            cost, h, b, _ = eliminate(cams, df, damping, points_free)
            out = [(i, j, 0.0, m.ravel(), b.get(i) if i == j else None) for (i, j), m in h.items()]
            return pd.DataFrame([*out, (-1, -1, cost, None, None)], columns=["i", "j", "cost", "h", "b"])

        part = self._rows(points).groupBy("_b").applyInPandas(run, _BLOCKS)
        total = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)]).alias(c)
        rows = part.groupBy("i", "j").agg(F.sum("cost").alias("cost"), total("h", 36), total("b", 6)).collect()  # camera blocks only
        cost, h, b = cams.edge_terms()
        for r in rows:
            if r.i < 0:
                cost += r.cost
                continue
            h[r.i, r.j] = h.get((r.i, r.j), 0) + np.array(r.h, float).reshape(6, 6)
            if r.i == r.j:
                b[r.i] = b.get(r.i, 0) + np.array(r.b, float)
        return cost, h, b

    def move_points(self, cams: Cameras, points: DataFrame, damping: float, step: dict) -> DataFrame:
        def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            back = eliminate(cams, df, damping, True)[3](step)
            p = df.drop_duplicates("landmark_id")[["landmark_id", "x", "y", "z"]].copy()
            p[["x", "y", "z"]] += np.stack([back[i] for i in p["landmark_id"]])
            return p

        return staged(self._rows(points).groupBy("_b").applyInPandas(run, "landmark_id long, x double, y double, z double"), "points")

    def optimise(self, iterations: int, points_free: bool = True, stop: float = 1e-6) -> float:
        """Levenberg-Marquardt until the cost falls by less than `stop` of itself; returns the cost."""
        damping = 1e-4
        cost, h, b = self.system(self.cams, self.points, damping, points_free)
        for _ in range(iterations):
            step = solve_cameras(h, b, self.cams.fixed, damping)
            cams = self.cams.moved(step)
            points = self.move_points(self.cams, self.points, damping, step) if points_free else self.points
            new, nh, nb = self.system(cams, points, damping, points_free)
            if new < cost:
                small = cost - new <= stop * cost
                if points_free:
                    discard(self.points)
                self.cams, self.points, cost, h, b, damping = cams, points, new, nh, nb, max(damping / 5, 1e-9)
                if small:
                    break
            else:
                if points_free:
                    discard(points)
                damping *= 10
                if damping > 1e6:
                    break
                cost, h, b = self.system(self.cams, self.points, damping, points_free)
        return cost

    def errors(self) -> DataFrame:
        """(landmark_id, frame_id, chi2, error, level)."""
        cams = self.cams

        def run(it):
            for df in it:
                *_, e, chi2 = _observed(cams, df)
                yield pd.DataFrame({"landmark_id": df["landmark_id"], "frame_id": df["frame_id"], "chi2": chi2, "error": np.sqrt((e * e).sum(1)), "level": df["level"]})

        return self.obs.join(self.points, "landmark_id").mapInPandas(run, "landmark_id long, frame_id long, chi2 double, error double, level int")

    def mark(self, limit: float) -> None:
        """Observations beyond `limit` leave the next round; those within come back."""
        e = self.errors().groupBy("landmark_id", "frame_id").agg(F.max("chi2").alias("chi2"))
        old, self.obs = self.obs, staged(self.obs.drop("level").join(e, ["landmark_id", "frame_id"]).withColumn("level", (F.col("chi2") > limit).cast("int")).drop("chi2"), "observations")
        discard(old)


@dataclass
class Refined:
    cameras: Cameras
    points: DataFrame
    errors: DataFrame
    before: float
    after: float


def observation_rows(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Observations of usable landmarks with the information of their pyramid layer; one per landmark and frame."""
    l = landmarks.where(F.col("sightings") >= USABLE_SIGHTINGS).select(F.col("id").alias("landmark_id"))  # noqa: E741
    layer = camera.octave_parts(F.col("octave"))[1]
    o = observations.join(l, "landmark_id").withColumn("info", camera.pixel_information(layer))
    return o.groupBy("landmark_id", "frame_id").agg(F.min_by("u", F.struct("u", "v")).alias("u"), F.min_by("v", F.struct("u", "v")).alias("v"), F.min_by("info", F.struct("u", "v")).alias("info"))


def refine(frames: DataFrame, landmarks: DataFrame, observations: DataFrame, start: dict[int, np.ndarray] | None = None, rounds=ROUNDS, pose_iterations: int = POSE_ITERATIONS, last=LAST, buckets: int | None = None) -> Refined:
    """The whole schedule: poses alone, rounds of everything with outliers taken out, a last round.

    frames: id, intrinsics, extrinsics; landmarks: id, x, y, z, sightings; observations: landmark_id,
    frame_id, u, v, octave.  `start`: device poses to begin from instead of the frames' own (the edges
    between frames keep the frames' own).  The most connected frame is fixed.
    """
    fixed = most_connected_frame(observations, landmarks).first()["frame_id"]
    cams = device_cameras([(r.id, r.intrinsics, r.extrinsics) for r in frames.select("id", "intrinsics", "extrinsics").toLocalIterator()], fixed)
    for i, pose in (start or {}).items():
        if i in cams.poses:
            cams.poses[i] = se3.flip_np(pose)
    p = Problem(cams, observation_rows(observations, landmarks), landmarks.select(F.col("id").alias("landmark_id"), "x", "y", "z"), buckets)
    mean = lambda: p.errors().where("level = 0").agg(F.avg("error")).first()[0] or 0.0
    before = mean()
    p.optimise(pose_iterations, points_free=False)
    for iterations, limit in rounds:
        p.optimise(iterations)
        p.mark(limit)
    p.optimise(last[0])
    p.mark(last[1])
    return Refined(p.cams, p.points, p.errors(), before, mean())


def device_poses(cams: Cameras) -> dict[int, np.ndarray]:
    return {i: se3.unflip_np(p) for i, p in cams.poses.items()}


def rescaled(cams: Cameras, factor: float, pivot: int) -> Cameras:
    """Camera positions moved away from that of the pivot frame by `factor` (0 or less: unchanged)."""
    if factor <= 0 or pivot not in cams.poses:
        return cams
    dev = device_poses(cams)
    c = dev[pivot][:3, 3].copy()
    out = {}
    for i, m in dev.items():
        m = m.copy()
        m[:3, 3] = c + (m[:3, 3] - c) * factor
        out[i] = se3.flip_np(m)
    return Cameras(out, cams.intrinsics, cams.fixed, cams.odometry, cams.gravity)
