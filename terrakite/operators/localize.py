"""Camera pose from matches of image points to landmarks: consensus search, gravity test, per image in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terrakite.functions import se3
from terrakite.operators.bundle import exp_se3

PIXELS, CONFIDENCE, TRIES, POLISH = 8.0, 0.99, 5000, 10
GRAVITY_DEGREES = 3.0
LEAST_MATCHES = 4

FOUND = "frame_id BIGINT, success BOOLEAN, inliers INT, matches INT, gravity_degrees DOUBLE, pose ARRAY<DOUBLE>, inlier_landmarks ARRAY<BIGINT>"


def project(m: np.ndarray, x: np.ndarray, k: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Pixels and depths of world points by a world-to-camera pose."""
    c = x @ m[:3, :3].T + m[:3, 3]
    z = np.where(np.abs(c[:, 2]) < 1e-9, 1e-9, c[:, 2])
    return np.stack([k[0] * c[:, 0] / z + k[2], k[1] * c[:, 1] / z + k[3]], 1), c[:, 2]


def polish(m: np.ndarray, x: np.ndarray, uv: np.ndarray, k, steps: int = POLISH, width: float = PIXELS) -> np.ndarray:
    """Gauss-Newton on the reprojection error, far points weighted down."""
    for _ in range(steps):
        c = x @ m[:3, :3].T + m[:3, 3]
        z = np.where(np.abs(c[:, 2]) < 1e-9, 1e-9, c[:, 2])
        e = np.stack([k[0] * c[:, 0] / z + k[2], k[1] * c[:, 1] / z + k[3]], 1) - uv
        w = 1 / (1 + (e * e).sum(1) / width**2) ** 2
        jp = np.zeros((len(x), 2, 3))
        jp[:, 0, 0], jp[:, 1, 1] = k[0] / z, k[1] / z
        jp[:, 0, 2], jp[:, 1, 2] = -k[0] * c[:, 0] / z**2, -k[1] * c[:, 1] / z**2
        turn = np.zeros((len(x), 3, 6))
        turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 0], turn[:, 1, 2], turn[:, 2, 0], turn[:, 2, 1] = c[:, 2], -c[:, 1], -c[:, 2], c[:, 0], c[:, 1], -c[:, 0]
        turn[:, :, 3:] = np.eye(3)
        j = jp @ turn
        h = np.einsum("nki,n,nkj->ij", j, w, j) + 1e-9 * np.eye(6)
        d = np.linalg.solve(h, -np.einsum("nki,n,nk->i", j, w, e))
        m = exp_se3(d) @ m
        if np.linalg.norm(d) < 1e-9:
            break
    return m


def three_point(x: np.ndarray, rays: np.ndarray) -> list[np.ndarray]:
    """World-to-camera poses from three points and unit rays: the distances by the quartic of Grunert, the pose by aligning the triangles."""
    a, b, c = (np.linalg.norm(x[i] - x[j]) for i, j in ((1, 2), (0, 2), (0, 1)))
    ca, cb, cg = rays[1] @ rays[2], rays[0] @ rays[2], rays[0] @ rays[1]
    if min(a, b, c) < 1e-9:
        return []
    a2, b2, c2 = a * a, b * b, c * c
    p, q = (a2 - c2) / b2, (a2 + c2) / b2
    co = [
        (p - 1) ** 2 - 4 * c2 / b2 * ca**2,
        4 * (p * (1 - p) * cb - (1 - q) * ca * cg + 2 * c2 / b2 * ca**2 * cb),
        2 * (p**2 - 1 + 2 * p**2 * cb**2 + 2 * (b2 - c2) / b2 * ca**2 - 4 * q * ca * cb * cg + 2 * (b2 - a2) / b2 * cg**2),
        4 * (-p * (1 + p) * cb + 2 * a2 / b2 * cg**2 * cb - (1 - q) * ca * cg),
        (1 + p) ** 2 - 4 * a2 / b2 * cg**2,
    ]
    out = []
    for v in np.roots(co):
        if abs(v.imag) > 1e-6 or v.real <= 0:
            continue
        v = v.real
        den = 2 * (cg - v * ca)
        if abs(den) < 1e-12:
            continue
        u = ((p - 1) * v * v - 2 * p * cb * v + 1 + p) / den
        s = 1 + v * v - 2 * v * cb
        if u <= 0 or s <= 0:
            continue
        s1 = b / np.sqrt(s)
        cam = rays * np.array([s1, u * s1, v * s1])[:, None]
        mx, mc = x.mean(0), cam.mean(0)
        uu, _, vt = np.linalg.svd((cam - mc).T @ (x - mx))
        r = uu @ np.diag([1, 1, np.sign(np.linalg.det(uu @ vt))]) @ vt
        out.append(se3.rigid_np(r, mc - r @ mx))
    return out


def consensus_pose(x: np.ndarray, uv: np.ndarray, k, guess: np.ndarray | None = None, seed: int = 0, tries: int = TRIES, pixels: float = PIXELS) -> tuple[np.ndarray | None, np.ndarray]:
    """(world-to-camera pose, inlier mask).  Matches are expected best first: early samples come from the front and the pool grows.

    Poses are scored by clipped squared errors; a better one is polished on its inliers.  Stops when
    CONFIDENCE that no better sample is left is reached.  No pose with fewer than four matches.
    """
    n = len(x)
    none = np.zeros(n, bool)
    if n < LEAST_MATCHES:
        return None, none
    rays = np.stack([(uv[:, 0] - k[2]) / k[0], (uv[:, 1] - k[3]) / k[1], np.ones(n)], 1)
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)

    def score(m):
        p, z = project(m, x, k)
        e2 = np.where(z > 0, ((p - uv) ** 2).sum(1), np.inf)
        return np.minimum(e2, pixels**2).sum(), e2 < pixels**2

    best, cost, inl = None, np.inf, none
    if guess is not None:
        cost, inl = score(guess)
        best = guess
    need, done = tries, 0
    while done < min(need, tries):
        pool = min(n, max(6, 6 + done * n // 200))
        at = rng.choice(pool, 3, replace=False)
        done += 1
        for m in three_point(x[at], rays[at]):
            s, ok = score(m)
            if s < cost and ok.sum() >= LEAST_MATCHES:
                m2 = polish(m, x[ok], uv[ok], k, width=pixels)
                s2, ok2 = score(m2)
                if s2 < s:
                    m, s, ok = m2, s2, ok2
                best, cost, inl = m, s, ok
                share = min(ok.mean(), 0.999999)
                need = int(np.ceil(np.log(1 - CONFIDENCE) / np.log(1 - share**3))) + 20
    if best is None or inl.sum() < LEAST_MATCHES:
        return None, none
    best = polish(best, x[inl], uv[inl], k, width=pixels)
    return best, score(best)[1]


def gravity_degrees(pose: np.ndarray, measured: np.ndarray) -> float:
    """Angle between down by a world-to-camera pose and the measured direction in the camera."""
    g = pose[:3, :3] @ np.array([0.0, -1.0, 0.0])
    m = measured / max(np.linalg.norm(measured), 1e-12)
    return float(np.degrees(np.arccos(np.clip(g @ m, -1, 1))))


def localize(matches: DataFrame, frames: DataFrame, gravity_limit: float = GRAVITY_DEGREES, tries: int = TRIES) -> DataFrame:
    """FOUND rows: the device pose of every frame from its matches.

    matches: frame_id, landmark_id, position (best first), x, y, z, u, v; frames: frame_id,
    intrinsics, gravity (direction in the camera, or null).  Fails with three matches or fewer, without
    a pose that four agree on, or if gravity is off by more than the limit.
    """
    f = frames.select("frame_id", "intrinsics", "gravity")
    j = matches.select("frame_id", "landmark_id", "position", "x", "y", "z", "u", "v").join(f, "frame_id")

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=["x", "y", "z", "u", "v"]).sort_values(["position", "landmark_id"])
        out = {"frame_id": key[0], "success": False, "inliers": 0, "matches": len(df), "gravity_degrees": None, "pose": None, "inlier_landmarks": None}
        if len(df) >= LEAST_MATCHES:
            i = df["intrinsics"].iloc[0]
            k = (i[0], i[4], i[6], i[7])
            m, ok = consensus_pose(df[["x", "y", "z"]].to_numpy(float), df[["u", "v"]].to_numpy(np.float32).astype(float), k, seed=int(key[0]) & 0xFFFFFFFF, tries=tries)
            if m is not None:
                g = df["gravity"].iloc[0]
                angle = gravity_degrees(m, np.array(g, float)) if g is not None else None
                out |= {"inliers": int(ok.sum()), "gravity_degrees": angle, "success": angle is None or angle <= gravity_limit}
                out |= {"pose": se3.unflip_np(m).ravel(order="F").tolist(), "inlier_landmarks": df["landmark_id"].to_numpy()[ok].tolist()}
        return pd.DataFrame([out])

    return j.groupBy("frame_id").applyInPandas(one, FOUND)
