"""Confidence, noise and outlier tests of one localization, over arrays of its inliers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from terrakite.functions import se3
from terrakite.streaming.config import TrackerConfig

INLIER_FIELDS = ("x", "y", "z", "u", "v", "size", "response", "octave")


@dataclass
class Measurement:
    """A localization: measured pose (map from camera), inliers (n x INLIER_FIELDS), camera and counts."""

    pose: np.ndarray
    inliers: np.ndarray
    total_matches: int
    focal: tuple[float, float]
    centre: tuple[float, float]
    t: float = 0.0
    confidence: float = 0.0
    noise: np.ndarray = field(default_factory=lambda: np.eye(6))

    def in_camera(self) -> np.ndarray:
        """Points in the camera, y down and z forward."""
        return (self.inliers[:, :3] - self.pose[:3, 3]) @ self.pose[:3, :3] * np.array([1.0, -1.0, -1.0])

    def distances(self) -> np.ndarray:
        return np.linalg.norm(self.inliers[:, :3] - self.pose[:3, 3], axis=1)


class ConfidenceEstimator(Protocol):
    def confidence(self, m: Measurement, c: TrackerConfig) -> float: ...
    def noise(self, m: Measurement, c: TrackerConfig) -> np.ndarray: ...


def _diagonal(position: float, orientation: float) -> np.ndarray:
    return np.diag(np.repeat([position, orientation], 3) ** 2)


class Simple:
    def confidence(self, m, c):
        return min(1.0, len(m.inliers) / c.max_inliers_for_confidence)

    def noise(self, m, c):
        f = 1 / max(c.min_confidence_factor, m.confidence)
        return _diagonal(c.base_position_noise * f, c.base_orientation_noise * f)


class Geometric(Simple):
    def confidence(self, m, c):
        if len(m.inliers) < c.min_inliers_for_tracking:
            spread = 0.1
        else:
            uv = np.floor(m.inliers[:, 3:5])
            w, h = uv.max(0) - uv.min(0) + 1
            spread = min(1.0, w * h / (640.0 * 480.0) * c.spatial_distribution_scale)
        return super().confidence(m, c) * spread

    def noise(self, m, c):
        return super().noise(m, c) * max(1.0, c.min_inliers_for_noise / max(1, len(m.inliers)))


class Stratified:
    def _counts(self, m, c):
        d = m.distances()
        near, far = int((d < c.near_threshold).sum()), int((d > c.far_threshold).sum())
        return d, near, len(d) - near - far, far

    def _quality(self, near, mid, far):
        n = near + mid + far
        if not n:
            return 0.0, 0.0
        p, r = min(0.9, near / 12), min(0.8, (far + mid // 2) / 8)
        return (max(0.2, p), max(0.3, r)) if n >= 15 else (p, r)

    def confidence(self, m, c):
        if len(m.inliers) < c.min_inliers_for_tracking:
            return 0.0
        p, r = self._quality(*self._counts(m, c)[1:])
        return (min(1.0, len(m.inliers) / 50) + 0.7 * p + 0.3 * r) / 2

    def noise(self, m, c):
        d, near, mid, far = self._counts(m, c)
        p, r = self._quality(near, mid, far)
        n, mean = len(d), float(d.mean()) if len(d) else 0.0
        few = np.sqrt(max(1.0, c.min_inliers_for_noise / max(n, 1e-9)))
        scale = few / max(c.min_confidence_factor, m.confidence)
        spread = 1 + d.std() / max(0.1, mean) if n > 1 else 1.0
        near_by = 1 / min(mean / c.near_threshold, 3.0) if mean > 0 else 1.0
        out = _diagonal(c.base_position_noise / max(0.1, p) * spread * scale, c.base_orientation_noise / max(0.1, r) * near_by * scale)
        if mean > c.far_threshold and far > near:
            s = min(mean * 0.005, 0.1)
            out[0, 4] = out[1, 3] = out[4, 0] = out[3, 1] = s
        return out


class Reprojection:
    def errors(self, m: Measurement) -> np.ndarray:
        """Pixel error of each inlier, NaN behind the camera."""
        p = m.in_camera()
        z = np.where(p[:, 2] > 0, p[:, 2], np.nan)
        uv = p[:, :2] / z[:, None] * np.array(m.focal) + np.array(m.centre)
        return np.linalg.norm(uv - m.inliers[:, 3:5], axis=1)

    def covariance(self, m: Measurement, c: TrackerConfig) -> np.ndarray:
        """Inverse Fisher information of the pose; an error belongs to its own inlier."""
        e = self.errors(m)
        ok = np.isfinite(e)
        p, inl, e = m.in_camera()[ok], m.inliers[ok], e[ok]
        fx, fy = m.focal
        x, y, z = p.T if len(p) else np.zeros((3, 0))
        zero = np.zeros_like(x)
        j = np.stack(
            [
                np.stack([-fx / z, zero, -fx * x / z**2, fx * x * y / z**2, fx * (1 + x**2 / z**2), -fx * y / z], 1),
                np.stack([zero, fy / z, -fy * y / z**2, fy * (1 + y**2 / z**2), fy * x * y / z**2, fy * x / z], 1),
            ],
            1,
        )
        proj = np.stack([np.stack([fx / z, zero, -fx * x / z**2], 1), np.stack([zero, fy / z, -fy * y / z**2], 1)], 1)
        jl = proj @ (np.diag([1.0, -1.0, -1.0]) @ m.pose[:3, :3].T)
        w = np.minimum(2.0, (inl[:, 7] + 2) / 3) * np.exp(-e / 2) * np.minimum(2.0, inl[:, 6] / 0.01)
        pixel = 1 / np.maximum(w, 1e-300)
        r = pixel[:, None, None] * np.eye(2) + c.landmark_position_noise**2 * jl @ jl.transpose(0, 2, 1)
        info = np.einsum("nki,nkl,nlj->ij", j, np.linalg.inv(r), j) if len(p) else np.zeros((6, 6))
        return np.linalg.inv(info + 1e-6 * np.eye(6))

    def confidence(self, m, c):
        n = len(m.inliers)
        e = self.errors(m)
        e = e[np.isfinite(e)]
        if n < c.min_inliers_for_tracking or not len(e):
            return 0.0
        v = np.diag(self.covariance(m, c))
        half = lambda x, at: float(np.exp(-0.6931471806 * x / at))
        ratio = n / m.total_matches if m.total_matches > 0 else 1.0
        out = 0.3 * half(np.sqrt((e * e).mean()), 5) + 0.3 * half(np.sqrt(v[:3].mean()), 0.5) + 0.2 * half(np.sqrt(v[3:].mean()), 0.25) + 0.1 * min(1.0, n / 30) + 0.1 * min(1.0, 10 * ratio)
        return max(0.01, min(0.95, out))

    def noise(self, m, c):
        if len(m.inliers) < 4:
            return _diagonal(c.base_position_noise, c.base_orientation_noise)
        out = self.covariance(m, c) / max(0.1, m.confidence)
        floor = np.repeat([c.reprojection_min_position_noise, c.reprojection_min_orientation_noise], 3) ** 2
        np.fill_diagonal(out, np.maximum(np.diag(out), floor))
        return out


class OutlierDetector(Protocol):
    def outlier(self, z: np.ndarray, x: np.ndarray, covariance: np.ndarray, confidence: float, c: TrackerConfig) -> bool: ...


class ChiSquared:
    def outlier(self, z, x, covariance, confidence, c):
        d = se3.pose_vector(z) - se3.pose_vector(x)
        return bool(d @ np.linalg.solve(covariance, d) > 0.5 * c.outlier_threshold / max(c.min_confidence_factor, confidence))


class Distance:
    def outlier(self, z, x, covariance, confidence, c):
        return bool(np.linalg.norm(z[:3, 3] - x[:3, 3]) > 2.0 or np.linalg.norm(se3.axis_angle_np(z[:3, :3] @ x[:3, :3].T)) > 0.5)


class LowConfidence:
    def outlier(self, z, x, covariance, confidence, c):
        return confidence < 0.3


ESTIMATORS = {"simple": Simple, "geometric": Geometric, "stratified": Stratified, "reprojection": Reprojection}
DETECTORS = {"chi_squared": ChiSquared, "distance": Distance, "confidence": LowConfidence}
