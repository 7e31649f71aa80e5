"""Scale-invariant keypoints and descriptors (Lowe 2004) in numpy, as a map over rows of grey images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LAYERS, SIGMA, ASSUMED_BLUR, CONTRAST, EDGE = 3, 1.6, 0.5, 0.02, 10.0
BORDER, NEWTON_STEPS, BINS, PEAK = 5, 5, 36, 0.8
WIDTH, DIRECTIONS, CLIP, GAIN = 4, 8, 0.2, 512.0
KEYPOINTS = "image_id BIGINT, idx INT, x FLOAT, y FLOAT, size FLOAT, angle FLOAT, response FLOAT, octave INT, desc BINARY"


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Odd length of about 8 sigma + 1."""
    n = int(round(8 * sigma + 1)) | 1
    x = np.arange(n) - n // 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return (k / k.sum()).astype(np.float32)


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    for axis in (0, 1):
        pad = np.pad(img, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(img.shape) > r else "edge")
        img = sum(w * (pad[i : i + img.shape[0]] if axis == 0 else pad[:, i : i + img.shape[1]]) for i, w in enumerate(k))
    return img.astype(np.float32)


def double(img: np.ndarray) -> np.ndarray:
    h, w = img.shape
    y, x = (np.arange(2 * h) + 0.5) / 2 - 0.5, (np.arange(2 * w) + 0.5) / 2 - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    ay, ax = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    top, low = img[y0][:, x0] * (1 - ax) + img[y0][:, x1] * ax, img[y1][:, x0] * (1 - ax) + img[y1][:, x1] * ax
    return (top * (1 - ay) + low * ay).astype(np.float32)


def pyramids(img: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Blurred stacks and their differences for each octave, from the doubled image."""
    base = blur(double(img.astype(np.float32)), float(np.sqrt(max(SIGMA**2 - (2 * ASSUMED_BLUR) ** 2, 0.01))))
    octaves = max(1, int(round(np.log2(min(base.shape)) - 2)))
    step = 2 ** (1 / LAYERS)
    add = [SIGMA * step**i * np.sqrt(step**2 - 1) for i in range(LAYERS + 2)]
    stacks = []
    for _ in range(octaves):
        stack = [base]
        for s in add:
            stack.append(blur(stack[-1], float(s)))
        stacks.append(np.stack(stack))
        base = stack[LAYERS][::2, ::2]
        if min(base.shape) < 8:
            break
    return stacks, [s[1:] - s[:-1] for s in stacks]


def extrema(d: np.ndarray, threshold: float) -> np.ndarray:
    """(layer, y, x) of values beyond the threshold that are the largest or least of their 27."""
    c = d[1:-1, BORDER:-BORDER, BORDER:-BORDER]
    if c.size == 0:
        return np.zeros((0, 3), int)
    most, least = np.full(c.shape, -np.inf, np.float32), np.full(c.shape, np.inf, np.float32)
    n, h, w = d.shape
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            for k in (-1, 0, 1):
                if i or j or k:
                    v = d[1 + i : n - 1 + i, BORDER + j : h - BORDER + j, BORDER + k : w - BORDER + k]
                    most, least = np.maximum(most, v), np.minimum(least, v)
    hit = (np.abs(c) > threshold) & (((c > 0) & (c >= most)) | ((c < 0) & (c <= least)))
    return np.argwhere(hit) + [1, BORDER, BORDER]


def refine(d: np.ndarray, at: np.ndarray):
    """(layer, y, x, offset, response) by Newton steps, or None where it wanders off, is faint, or lies on an edge."""
    s, y, x = at
    for _ in range(NEWTON_STEPS):
        c = d[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2].astype(float) / 255
        g = np.array([c[1, 1, 2] - c[1, 1, 0], c[1, 2, 1] - c[1, 0, 1], c[2, 1, 1] - c[0, 1, 1]]) / 2
        v = 2 * c[1, 1, 1]
        xx, yy, ss = c[1, 1, 2] + c[1, 1, 0] - v, c[1, 2, 1] + c[1, 0, 1] - v, c[2, 1, 1] + c[0, 1, 1] - v
        xy = (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
        xs = (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4
        ys = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4
        h = np.array([[xx, xy, xs], [xy, yy, ys], [xs, ys, ss]])
        o = -np.linalg.lstsq(h, g, rcond=None)[0]
        if (np.abs(o) < 0.5).all():
            break
        if (np.abs(o) > 1e6).any():
            return None
        x, y, s = x + int(round(o[0])), y + int(round(o[1])), s + int(round(o[2]))
        if not (1 <= s <= LAYERS and BORDER <= y < d.shape[1] - BORDER and BORDER <= x < d.shape[2] - BORDER):
            return None
    else:
        return None
    response = c[1, 1, 1] + g @ o / 2
    det, tr = xx * yy - xy * xy, xx + yy
    if abs(response) * LAYERS < CONTRAST or det <= 0 or tr * tr * EDGE >= (EDGE + 1) ** 2 * det:
        return None
    return s, y, x, o, abs(response)


def orientations(img: np.ndarray, y: int, x: int, scale: float) -> list[float]:
    """Peaks of the smoothed histogram of gradient directions, in degrees counted clockwise from the right."""
    r, sig = int(round(4.5 * scale)), 1.5 * scale
    y0, y1, x0, x1 = max(1, y - r), min(img.shape[0] - 2, y + r), max(1, x - r), min(img.shape[1] - 2, x + r)
    if y0 > y1 or x0 > x1:
        return []
    dx = img[y0 : y1 + 1, x0 + 1 : x1 + 2] - img[y0 : y1 + 1, x0 - 1 : x1]
    dy = img[y0 - 1 : y1, x0 : x1 + 1] - img[y0 + 1 : y1 + 2, x0 : x1 + 1]
    yy, xx = np.mgrid[y0 - y : y1 + 1 - y, x0 - x : x1 + 1 - x]
    w = np.exp(-(yy**2 + xx**2) / (2 * sig * sig)) * np.hypot(dx, dy)
    b = np.round(BINS / 360 * (np.degrees(np.arctan2(dy, dx)) % 360)).astype(int) % BINS
    h = np.bincount(b.ravel(), w.ravel(), BINS)
    h = (np.roll(h, 2) + np.roll(h, -2)) / 16 + (np.roll(h, 1) + np.roll(h, -1)) / 4 + h * 6 / 16
    lo, hi = np.roll(h, 1), np.roll(h, -1)
    out = []
    for i in np.flatnonzero((h > lo) & (h > hi) & (h >= PEAK * h.max())):
        k = (i + 0.5 * (lo[i] - hi[i]) / (lo[i] - 2 * h[i] + hi[i])) % BINS
        out.append(float((360 - 360 / BINS * k) % 360))
    return out


def descriptor(img: np.ndarray, px: float, py: float, angle: float, scale: float) -> np.ndarray:
    """128 bytes: gradients around a point in 4 x 4 cells of 8 directions, interpolated, clipped and normalised."""
    d, n = WIDTH, DIRECTIONS
    hist = 3 * scale
    radius = min(int(round(hist * 1.4142135 * (d + 1) / 2)), int(np.hypot(*img.shape)))
    yc, xc = int(round(py)), int(round(px))
    c, s = np.cos(np.radians(angle)) / hist, np.sin(np.radians(angle)) / hist
    i, j = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    cr, rr = j * c - i * s, j * s + i * c
    rb, cb = rr + d / 2 - 0.5, cr + d / 2 - 0.5
    y, x = yc + i, xc + j
    ok = (rb > -1) & (rb < d) & (cb > -1) & (cb < d) & (y > 0) & (y < img.shape[0] - 1) & (x > 0) & (x < img.shape[1] - 1)
    rb, cb, y, x, rr, cr = rb[ok], cb[ok], y[ok], x[ok], rr[ok], cr[ok]
    dx, dy = img[y, x + 1] - img[y, x - 1], img[y - 1, x] - img[y + 1, x]
    ob = ((np.degrees(np.arctan2(dy, dx)) - angle) % 360) * n / 360
    mag = np.hypot(dx, dy) * np.exp(-(rr**2 + cr**2) / (d * d * 0.5))
    r0, c0, o0 = (np.floor(v).astype(int) for v in (rb, cb, ob))
    fr, fc, fo = rb - r0, cb - c0, ob - o0
    out = np.zeros((d + 2, d + 2, n))
    for a in (0, 1):
        for b in (0, 1):
            for k in (0, 1):
                w = mag * (fr if a else 1 - fr) * (fc if b else 1 - fc) * (fo if k else 1 - fo)
                np.add.at(out, (r0 + 1 + a, c0 + 1 + b, (o0 + k) % n), w)
    v = out[1:-1, 1:-1].ravel()
    v = np.minimum(v, CLIP * np.linalg.norm(v))
    return np.clip(np.round(v * GAIN / max(np.linalg.norm(v), 1e-7)), 0, 255).astype(np.uint8)


def detect_and_compute(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x (x, y, size, angle, response, octave code), n x 128 bytes) of a grey image of bytes."""
    if min(img.shape, default=0) < 16:
        return np.zeros((0, 6)), np.zeros((0, 128), np.uint8)
    stacks, diffs = pyramids(img)
    kps, descs = [], []
    threshold = np.floor(0.5 * 0.04 / LAYERS * 255)
    for o, (g, d) in enumerate(zip(stacks, diffs)):
        for at in extrema(d, threshold):
            found = refine(d, at)
            if found is None:
                continue
            s, y, x, off, response = found
            scale = SIGMA * 2 ** ((s + off[2]) / LAYERS)
            for turn in orientations(g[s], y, x, scale):
                px, py = x + off[0], y + off[1]
                code = ((o - 1) & 255) | (s << 8) | (int(round((off[2] + 0.5) * 255)) << 16)
                f = 2.0 ** (o - 1)
                kps.append((px * f, py * f, scale * f * 2, turn, response, code))
                descs.append(descriptor(g[s], px, py, (360 - turn) % 360, scale))
    return np.array(kps).reshape(-1, 6), np.array(descs, np.uint8).reshape(-1, 128)


def extract(images: DataFrame) -> DataFrame:
    """KEYPOINTS rows of images (image_id, width, height, data: one byte a pixel, row by row).  Images whose bytes do not fit their size give none."""

    def run(it):
        for df in it:
            for r in df.itertuples():
                if r.data is None or r.width != r.width or r.height != r.height or len(r.data) != r.width * r.height or not r.width:
                    continue
                k, d = detect_and_compute(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width)))
                yield pd.DataFrame(
                    {"image_id": r.image_id, "idx": np.arange(len(k)), "x": k[:, 0], "y": k[:, 1], "size": k[:, 2], "angle": k[:, 3], "response": k[:, 4], "octave": k[:, 5].astype(int), "desc": [v.tobytes() for v in d]}
                )

    return images.select("image_id", "width", "height", "data").mapInPandas(run, KEYPOINTS)
