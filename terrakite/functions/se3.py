"""Rigid transforms: column expressions over column-major arrays of 16 (or 9), and the same in numpy for many rows at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, row: int, col: int, size: int = 4) -> Column:
    return m[col * size + row]


def matrix(cells: list[list[Column]]) -> Column:
    """A column-major array from rows of cells."""
    return F.array(*[cells[r][c] for c in range(len(cells[0])) for r in range(len(cells))])


def position(m: Column) -> tuple[Column, Column, Column]:
    return at(m, 0, 3), at(m, 1, 3), at(m, 2, 3)


def rotation(m: Column) -> list[list[Column]]:
    return [[at(m, r, c) for c in range(3)] for r in range(3)]


def compose(r: list[list[Column]], t: tuple[Column, ...]) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return matrix([[*r[i], t[i]] for i in range(3)] + [[zero, zero, zero, one]])


def bound(f, **parts: Column) -> Column:
    """f of the parts, each of them evaluated once: a matrix has 16 cells, and nested products of plain expressions would repeat their inputs 16-fold a level."""
    row = F.struct(*[c.alias(n) for n, c in parts.items()])
    return F.get(F.transform(F.array(row), lambda s: f(**{n: s[n] for n in parts})), F.lit(0))


def multiply(a: Column, b: Column, size: int = 4) -> Column:
    return bound(lambda a, b: _multiply(a, b, size), a=a, b=b)


def _multiply(a: Column, b: Column, size: int) -> Column:
    cell = lambda r, c: sum((at(a, r, k, size) * at(b, k, c, size) for k in range(1, size)), at(a, r, 0, size) * at(b, 0, c, size))
    return matrix([[cell(r, c) for c in range(size)] for r in range(size)])


def invert_rigid(m: Column) -> Column:
    """Inverse of a rotation and translation."""
    return bound(_invert, m=m)


def _invert(m: Column) -> Column:
    r, t = rotation(m), position(m)
    rt = [[r[c][k] for c in range(3)] for k in range(3)]
    return compose(rt, tuple(-(rt[i][0] * t[0] + rt[i][1] * t[1] + rt[i][2] * t[2]) for i in range(3)))


def apply_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(at(m, r, 0) * x + at(m, r, 1) * y + at(m, r, 2) * z + at(m, r, 3) for r in range(3))


def flip_camera(m: Column) -> Column:
    """Device pose (y up, z backward) to optimiser pose: columns 1 and 2 negated, then inverted."""
    return invert_rigid(bound(_negate_columns, m=m))


def unflip_camera(m: Column) -> Column:
    """The inverse of flip_camera."""
    return bound(_negate_columns, m=invert_rigid(m))


def _negate_columns(m: Column) -> Column:
    sign = [1, -1, -1, 1]
    return matrix([[at(m, r, c) * sign[c] for c in range(4)] for r in range(4)])


def rotation_from_axis_angle(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rodrigues; below 1e-10 rad the identity."""
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle < 1e-10
    n = F.when(small, 1.0).otherwise(angle)
    k = [x / n, y / n, z / n]
    s, c = F.sin(angle), F.cos(angle)
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    eye = lambda i, j: F.lit(1.0 if i == j else 0.0)
    return [[F.when(small, eye(i, j)).otherwise(c * eye(i, j) + s * skew[i][j] + (1 - c) * k[i] * k[j]) for j in range(3)] for i in range(3)]


def rotation_from_quaternion(w: Column, x: Column, y: Column, z: Column, normalise: bool = True) -> list[list[Column]]:
    if normalise:
        n = F.sqrt(w * w + x * x + y * y + z * z)
        w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_from_rotation(r: list[list[Column]]) -> tuple[Column, Column, Column, Column]:
    """w, x, y, z, by the largest of the trace and the diagonal (Shepperd)."""
    trace = r[0][0] + r[1][1] + r[2][2]
    root = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(1e-300)))
    s0, s1 = root(trace + 1), root(1 + r[0][0] - r[1][1] - r[2][2])
    s2, s3 = root(1 + r[1][1] - r[0][0] - r[2][2]), root(1 + r[2][2] - r[0][0] - r[1][1])
    d = (r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1])
    p = (r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1])
    a, b = trace > 0, (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    c = r[1][1] > r[2][2]
    pick = lambda v0, v1, v2, v3: F.when(a, v0).when(b, v1).when(c, v2).otherwise(v3)
    return (
        pick(s0 / 4, d[0] / s1, d[1] / s2, d[2] / s3),
        pick(d[0] / s0, s1 / 4, p[0] / s2, p[1] / s3),
        pick(d[1] / s0, p[0] / s1, s2 / 4, p[2] / s3),
        pick(d[2] / s0, p[1] / s1, p[2] / s2, s3 / 4),
    )


def sfm_pose(qw: Column, qx: Column, qy: Column, qz: Column, tx: Column, ty: Column, tz: Column, normalise: bool = False) -> Column:
    """World-to-camera quaternion and translation (y down, z forward) to a device pose: position -R't with y, z negated, and the rotation flipped on both sides."""
    r = rotation_from_quaternion(qw, qx, qy, qz, normalise)
    t, sign = (tx, ty, tz), (1, -1, -1)
    rt = [[r[c][k] for c in range(3)] for k in range(3)]
    pos = tuple(-(rt[i][0] * t[0] + rt[i][1] * t[1] + rt[i][2] * t[2]) * sign[i] for i in range(3))
    return compose([[rt[i][j] * sign[i] * sign[j] for j in range(3)] for i in range(3)], pos)


def relative_pose(a: Column, b: Column) -> Column:
    """R2 R1' and R2 (-R1' t1) + t2 of two world-to-camera poses."""
    return multiply(b, invert_rigid(a))


def valid_transform(m: Column) -> Column:
    """Bottom row within 1e-6 of 0 0 0 1, rotation orthonormal within 1e-4, determinant within 1e-4 of +-1, all finite.  Null is not valid."""
    bottom = F.lit(True)
    for c, v in enumerate((0.0, 0.0, 0.0, 1.0)):
        bottom = bottom & (F.abs(at(m, 3, c) - v) <= 1e-6)
    r = rotation(m)
    gram = sum(
        ((sum((r[k][i] * r[k][j] for k in (1, 2)), r[0][i] * r[0][j]) - (1.0 if i == j else 0.0)) ** 2 for i in range(3) for j in range(3)), F.lit(0.0),
    )
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    finite = ~F.exists(m, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(m) == 16) & finite & bottom & (F.sqrt(gram) <= 1e-4) & (F.abs(F.abs(det) - 1) <= 1e-4), F.lit(False))


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Frobenius distance below `tolerance`."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)) < tolerance


def transpose(m: Column, size: int = 4) -> Column:
    return matrix([[at(m, c, r, size) for c in range(size)] for r in range(size)])


# --- numpy, for state machines and solvers -------------------------------------------------------------------------


def axis_angle_np(r: np.ndarray) -> np.ndarray:
    """Axis times angle of a 3 x 3 rotation, by its quaternion, which is stable at 0 and at pi."""
    q = quaternion_np(r)
    v = q[1:] if q[0] >= 0 else -q[1:]
    n, w = np.linalg.norm(v), abs(q[0])
    return np.zeros(3) if n < 1e-15 else v / n * (2 * np.arctan2(n, w))


def rotation_np(v: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(v))
    if angle < 1e-10:
        return np.eye(3)
    k = np.asarray(v, float) / angle
    s = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * s + (1 - np.cos(angle)) * s @ s


def quaternion_np(r: np.ndarray) -> np.ndarray:
    """w, x, y, z: the eigenvector of Bar-Itzhack's symmetric matrix, largest part positive."""
    m = np.asarray(r, float)
    k = np.array(
        [
            [m[0, 0] - m[1, 1] - m[2, 2], m[1, 0] + m[0, 1], m[2, 0] + m[0, 2], m[2, 1] - m[1, 2]],
            [m[1, 0] + m[0, 1], m[1, 1] - m[0, 0] - m[2, 2], m[2, 1] + m[1, 2], m[0, 2] - m[2, 0]],
            [m[2, 0] + m[0, 2], m[2, 1] + m[1, 2], m[2, 2] - m[0, 0] - m[1, 1], m[1, 0] - m[0, 1]],
            [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m[0, 0] + m[1, 1] + m[2, 2]],
        ]
    )
    x, y, z, w = np.linalg.eigh(k / 3)[1][:, -1]
    return np.array([w, x, y, z]) * (1 if w >= 0 else -1)


def rigid_np(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, t
    return m


def inverse_np(m: np.ndarray) -> np.ndarray:
    return rigid_np(m[:3, :3].T, -m[:3, :3].T @ m[:3, 3])


def pose_vector(m: np.ndarray) -> np.ndarray:
    """Position and axis-angle."""
    return np.concatenate([m[:3, 3], axis_angle_np(m[:3, :3])])


def pose_matrix(v: np.ndarray) -> np.ndarray:
    return rigid_np(rotation_np(v[3:]), v[:3])


def valid_np(m: np.ndarray) -> bool:
    m = np.asarray(m, float)
    if m.shape != (4, 4) or not np.isfinite(m).all() or np.abs(m[3] - [0, 0, 0, 1]).max() > 1e-6:
        return False
    r = m[:3, :3]
    return bool(np.linalg.norm(r.T @ r - np.eye(3)) <= 1e-4 and abs(abs(np.linalg.det(r)) - 1) <= 1e-4)


def interpolate_np(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Positions on a line, rotations on the shorter arc; alpha is clamped to 0..1."""
    alpha = min(1.0, max(0.0, alpha))
    turn = axis_angle_np(a[:3, :3].T @ b[:3, :3])
    return rigid_np(a[:3, :3] @ rotation_np(alpha * turn), (1 - alpha) * a[:3, 3] + alpha * b[:3, 3])


def flip_np(m: np.ndarray) -> np.ndarray:
    return inverse_np(m @ np.diag([1.0, -1.0, -1.0, 1.0]))


def unflip_np(m: np.ndarray) -> np.ndarray:
    return inverse_np(m) @ np.diag([1.0, -1.0, -1.0, 1.0])
