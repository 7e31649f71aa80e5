"""Camera geometry, keypoint codes and depth maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrakite.functions import se3


def project_to_world(pose: Column, f: Column, cx: Column, cy: Column, u: Column, v: Column, depth: Column) -> tuple[Column, Column, Column]:
    """World point of a pixel at a depth along the view; one focal length for both axes."""
    return se3.apply_point(pose, (u - cx) * depth / f, -(v - cy) * depth / f, -depth)


def camera_point(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R'(p - t): the point in the camera's own frame (y up, z backward)."""
    r, t = se3.rotation(pose), se3.position(pose)
    d = (x - t[0], y - t[1], z - t[2])
    return tuple(r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3))


def project_to_image(pose: Column, f: Column, cx: Column, cy: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a world point, single precision."""
    c = camera_point(pose, x, y, z)
    s = f / -c[2]
    return (c[0] * s + cx).cast("float"), (-c[1] * s + cy).cast("float")


def octave_parts(code: Column) -> tuple[Column, Column, Column, Column]:
    """(octave, layer, sub-layer, scale) of a packed octave code: signed low byte, next byte, third byte; scale 2**-octave."""
    low = code.bitwiseAND(255)
    octave = F.when(low < 128, low).otherwise(low - 256)
    return octave, F.shiftright(code, 8).bitwiseAND(255), F.shiftright(code, 16).bitwiseAND(255), F.pow(F.lit(2.0), -octave)


def full_resolution(value: Column, octave: Column) -> Column:
    """A coordinate or scale of an octave in pixels of the image: times 2**octave."""
    return value * F.pow(F.lit(2.0), octave)


def octave_space(value: Column, octave: Column) -> Column:
    return value * F.pow(F.lit(2.0), -octave)


def pixel_information(layer: Column) -> Column:
    """4 / (2**(1/3))**(2 layer), clamped to 0.1..100."""
    return F.least(F.greatest(4.0 / F.pow(F.lit(2.0 ** (1 / 3)), 2 * layer), F.lit(0.1)), F.lit(100.0))


def pair_id(a: Column, b: Column) -> Column:
    """One number for two image ids in either order."""
    return F.least(a, b) * F.lit(2147483647).cast("long") + F.greatest(a, b)


# --- depth maps ----------------------------------------------------------------------------------------------------


def read_pfm(data: bytes) -> np.ndarray:
    """A one-channel PFM picture, top row first."""
    kind, size, scale, body = data.split(b"\n", 3)
    if kind.strip() != b"Pf":
        raise ValueError("not a one-channel PFM picture")
    w, h = map(int, size.split())
    return np.frombuffer(body, "<f4" if float(scale) < 0 else ">f4", w * h).reshape(h, w)[::-1].astype(np.float32)


def saved_depth(depth: np.ndarray, confidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels 0, 1, 2 of confidence become 0, 1, 100; depth is five times as far where confidence is 0."""
    level = np.select([confidence == 1, confidence == 2], [1.0, 100.0], np.where(confidence == 0, 0.0, confidence))
    return np.where(level == 0, depth * 5, depth), level


def sample_bilinear(picture: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Values at points given in an image of width x height, by bilinear interpolation; points outside take the border."""
    h, w = picture.shape
    px = np.clip(np.asarray(x, float) * w / width, 0, w - 1)
    py = np.clip(np.asarray(y, float) * h / height, 0, h - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    ax, ay = px - x0, py - y0
    top = picture[y0, x0] * (1 - ax) + picture[y0, x1] * ax
    return top * (1 - ay) + (picture[y1, x0] * (1 - ax) + picture[y1, x1] * ax) * ay


def surface_normals(depth: np.ndarray, f: float, pose: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Unit normals in the world at image points: depth gradients over the size of a cell there; cells are clamped at both borders."""
    h, w = depth.shape
    cx = np.clip((np.asarray(x, float) * w / width).astype(int), 1, w - 2)
    cy = np.clip((np.asarray(y, float) * h / height).astype(int), 1, h - 2)
    cell = depth[cy, cx] / (f * w / width)
    gx = (depth[cy, cx + 1] - depth[cy, cx - 1]) / 2 / cell
    gy = (depth[cy + 1, cx] - depth[cy - 1, cx]) / 2 / cell
    n = np.stack([gx, -gy, np.ones_like(gx)], 1)
    return n / np.linalg.norm(n, axis=1, keepdims=True) @ pose[:3, :3].T
