"""Pose filters: they predict with the device's motion and correct with localizations."""

from __future__ import annotations

from collections import deque
from typing import Protocol

import numpy as np

from terrakite.functions import se3
from terrakite.operators.bundle import Cameras, eliminate, solve_cameras
from terrakite.streaming.config import TrackerConfig
from terrakite.streaming.measurement import Measurement


class PoseFilter(Protocol):
    ready: bool

    def start(self, m: Measurement, c: TrackerConfig) -> None: ...
    def predict(self, motion: np.ndarray, dt: float, c: TrackerConfig) -> None: ...
    def update(self, m: Measurement, c: TrackerConfig) -> None: ...
    def pose(self) -> np.ndarray: ...
    def covariance(self) -> np.ndarray: ...
    def uncertainty(self) -> float: ...


def _moved(x: np.ndarray, motion: np.ndarray) -> np.ndarray:
    return se3.pose_vector(se3.pose_matrix(x) @ motion)


def _drift(motion: np.ndarray, dt: float, c: TrackerConfig) -> tuple[float, float]:
    d = float(np.linalg.norm(motion[:3, 3]))
    return c.motion_position_noise_scale * d + c.time_position_noise_scale * dt, c.motion_orientation_noise_scale * d + c.time_orientation_noise_scale * dt


class PassThrough:
    """The state is the last localization, carried on by the motion."""

    def __init__(self):
        self.x, self.ready = np.zeros(6), False

    def start(self, m, c):
        self.x, self.ready = se3.pose_vector(m.pose), True

    def predict(self, motion, dt, c):
        self.x = _moved(self.x, motion)

    def update(self, m, c):
        self.x = se3.pose_vector(m.pose)

    def pose(self):
        return se3.pose_matrix(self.x)

    def covariance(self):
        return np.diag(np.repeat([5.0, 0.2], 3) ** 2)

    def uncertainty(self):
        return 5.0


class Averaging(PassThrough):
    """Nine parts state, one part localization."""

    keep = 0.9

    def __init__(self):
        super().__init__()
        self.u = 1.0

    def start(self, m, c):
        super().start(m, c)
        self.u = c.initial_position_uncertainty

    def predict(self, motion, dt, c):
        super().predict(motion, dt, c)
        self.u += _drift(motion, dt, c)[0]

    def update(self, m, c):
        self.x = self.keep * self.x + (1 - self.keep) * se3.pose_vector(m.pose)
        self.u = self.keep * self.u + (1 - self.keep) * c.base_position_noise

    def covariance(self):
        return np.diag(np.repeat([self.u**2, self.u * 0.1], 3))

    def uncertainty(self):
        return self.u


class Kalman(PassThrough):
    """Kalman filter on position and axis-angle; optionally held by well-localized poses of the past."""

    def __init__(self):
        super().__init__()
        self.p, self.held = np.eye(6), deque()

    def start(self, m, c):
        super().start(m, c)
        self.p = m.noise.copy()

    def predict(self, motion, dt, c):
        super().predict(motion, dt, c)
        self.p = self.p + np.diag(np.repeat(_drift(motion, dt, c), 3))

    def update(self, m, c):
        gain = self.p @ np.linalg.inv(self.p + m.noise)
        self.x = self.x + gain @ (se3.pose_vector(m.pose) - self.x)
        self.p = (np.eye(6) - gain) @ self.p

    def update_with_anchors(self, m, c):
        """update, then remember the pose if it is good, then turn towards remembered poses nearby."""
        self.update(m, c)
        n = len(m.inliers)
        apart = all(np.linalg.norm(m.pose[:3, 3] - a[0][:3, 3]) >= c.anchor_min_spacing for a in self.held)
        if m.confidence >= c.anchor_min_confidence and n >= c.anchor_min_features and apart:
            self.held.append((m.pose, m.confidence, m.t, n))
            while len(self.held) > c.anchor_max_count:
                self.held.popleft()
        if not c.enable_anchor_constraints:
            return
        turn, total = np.zeros(3), 0.0
        now = se3.rotation_np(self.x[3:])
        for pose, confidence, t, count in self.held:
            d, age = float(np.linalg.norm(self.x[:3] - pose[:3, 3])), m.t - t
            if d > c.anchor_max_distance or age > c.anchor_max_age:
                continue
            w = np.exp(-d / c.anchor_distance_scale) * np.exp(-age / c.anchor_time_scale) * confidence * np.sqrt(count / 50)
            if w > c.anchor_min_relevance:
                turn, total = turn + w * se3.axis_angle_np(pose[:3, :3] @ now.T), total + w
        if total > 0:
            turn = turn / total
            size = np.linalg.norm(turn)
            if size > c.anchor_max_correction:
                turn *= c.anchor_max_correction / size
            self.x[3:] += c.anchor_correction_strength * turn
            self.p[3:, 3:] *= 1 - 0.3 * c.anchor_correction_strength

    def covariance(self):
        return self.p

    def uncertainty(self):
        return float(np.trace(self.p[:3, :3]))


class Smooth(PassThrough):
    """The state creeps towards the last localization, as far as the motion hides it."""

    def __init__(self):
        super().__init__()
        self.goal, self.u = np.zeros(6), 10.0

    def start(self, m, c):
        super().start(m, c)
        self.goal, self.u = self.x.copy(), 1.0

    def predict(self, motion, dt, c):
        super().predict(motion, dt, c)
        self.goal = _moved(self.goal, motion)
        self.u += _drift(motion, dt, c)[0]
        way = float(np.linalg.norm(motion[:3, 3])) + float(np.linalg.norm(se3.axis_angle_np(motion[:3, :3]))) * c.smooth_filter_rotation_scale
        budget = way * c.smooth_filter_alpha + dt * 0.001
        delta = self.goal - self.x
        off = np.array([np.linalg.norm(delta[:3]), np.linalg.norm(delta[3:])])
        open_ = off > 1e-4
        if open_.any():
            share = np.where(open_, off, 0.0) / off[open_].sum()
            part = np.where(open_, np.minimum(budget * share, off) / np.maximum(off, 1e-300), 0.0)
            self.x = self.x + np.repeat(part, 3) * delta

    def update(self, m, c):
        self.goal = se3.pose_vector(m.pose)
        self.u = c.base_position_noise / max(m.confidence, 0.1)

    def covariance(self):
        return np.diag(np.repeat([self.u**2, 0.1**2], 3))

    def uncertainty(self):
        return self.u


class SlidingWindow(PassThrough):
    """The last localizations refined together against their fixed landmarks and the motion between them."""

    def __init__(self):
        super().__init__()
        self.p, self.frames, self.next = np.eye(6), deque(), 0

    def _add(self, m):
        self.frames.append([self.next, m.pose, m])
        self.next += 1

    def start(self, m, c):
        super().start(m, c)
        self.p = m.noise.copy()
        self._add(m)

    def predict(self, motion, dt, c):
        super().predict(motion, dt, c)
        self.p = self.p + np.diag(np.repeat(_drift(motion, dt, c), 3))

    def update(self, m, c):
        self._add(m)
        while len(self.frames) > c.sliding_window_max_keyframes:
            self.frames.popleft()
        if len(self.frames) < 2:
            return
        import pandas as pd

        cams = Cameras({i: se3.flip_np(p) for i, p, _ in self.frames}, {i: (k.focal[0], *k.centre) for i, _, k in self.frames})
        for (i, p, _), (j, q, _) in zip(self.frames, list(self.frames)[1:]):
            rel = se3.inverse_np(p) @ q
            s = 1 / max(0.1, float(np.linalg.norm(rel[:3, 3])))
            cams.odometry.append((i, j, cams.poses[j] @ se3.inverse_np(cams.poses[i]), np.repeat([50.0 * s, 25.0 * s], 3)))
        rows = [pd.DataFrame(k.inliers[:, :5], columns=["x", "y", "z", "u", "v"]).assign(frame_id=i, landmark_id=np.arange(len(k.inliers)), info=1.0, level=0) for i, _, k in self.frames]
        df, damping = pd.concat(rows), 1e-5

        def terms(cm, lam):
            cost, h, b = cm.edge_terms()
            if len(df):
                c2, h2, b2, _ = eliminate(cm, df, lam, False)
                cost += c2
                for k, v in h2.items():
                    h[k] = h.get(k, 0) + v
                for k, v in b2.items():
                    b[k] = b.get(k, 0) + v
            return cost, h, b

        cost, h, b = terms(cams, damping)
        for _ in range(c.sliding_window_optimization_iterations):
            new = cams.moved(solve_cameras(h, b, set(), damping))
            c2, h2, b2 = terms(new, damping)
            if c2 < cost:
                cams, cost, h, b, damping = new, c2, h2, b2, damping / 5
            else:
                damping *= 10
        for f in self.frames:
            f[1] = se3.unflip_np(cams.poses[f[0]])
        self.x = se3.pose_vector(self.frames[-1][1])
        self.p = self._marginal(h, [f[0] for f in self.frames])

    @staticmethod
    def _marginal(h, ids):
        """Covariance of the newest pose, widened, with floors of 2 cm and 1 degree; 20 cm and 5 degrees if the system is singular."""
        n = len(ids)
        m = np.zeros((6 * n, 6 * n))
        for (i, j), v in h.items():
            a, b = ids.index(i), ids.index(j)
            m[6 * a : 6 * a + 6, 6 * b : 6 * b + 6] = v
        if np.linalg.cond(m) > 1e15:
            return np.diag(np.repeat([0.2, np.radians(5)], 3) ** 2)
        v = np.linalg.inv(m)[-6:, -6:]
        order = [3, 4, 5, 0, 1, 2]  # translation first
        v = v[np.ix_(order, order)]
        v[:3, :3] *= 50
        v[3:, 3:] *= 25
        np.fill_diagonal(v, np.maximum(np.diag(v), np.repeat([0.02, np.radians(1)], 3) ** 2))
        return v

    def covariance(self):
        return self.p

    def uncertainty(self):
        return float(np.sqrt(np.diag(self.p)[:3].mean()))


FILTERS = {"pass_through": PassThrough, "averaging": Averaging, "kalman": Kalman, "smooth": Smooth, "sliding_window": SlidingWindow}


def make_filter(name: str) -> PoseFilter:
    """The filter of that name; an unknown one gives the sliding window."""
    return FILTERS.get(name, SlidingWindow)()
