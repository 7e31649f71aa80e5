"""Confidence and noise of a localization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_confidence(inliers: Column, full: float = 50.0) -> Column:
    return F.least(F.lit(1.0), inliers / full)


def simple_noise(confidence: Column, base_position: float = 0.2, base_orientation: float = 0.1, least: float = 0.1) -> tuple[Column, Column]:
    """(position variance, orientation variance)."""
    f = 1 / F.greatest(F.lit(least), confidence)
    return (base_position * f) * (base_position * f), (base_orientation * f) * (base_orientation * f)


def geometric_confidence(inliers: Column, spread: Column, full: float = 50.0) -> Column:
    return simple_confidence(inliers, full) * spread


def geometric_noise(confidence: Column, inliers: Column, few: float = 20.0) -> tuple[Column, Column]:
    """simple_noise, wider where inliers are fewer than `few`."""
    p, o = simple_noise(confidence)
    more = F.greatest(F.lit(1.0), few / inliers)
    return p * more, o * more


def position_quality(near: Column, n: Column) -> Column:
    q = F.least(F.lit(0.9), near / 12.0)
    return F.when(n == 0, 0.0).when(n >= 15, F.greatest(F.lit(0.2), q)).otherwise(q)


def rotation_quality(mid: Column, far: Column, n: Column) -> Column:
    q = F.least(F.lit(0.8), (far + F.floor(mid / 2)) / 8.0)
    return F.when(n == 0, 0.0).when(n >= 15, F.greatest(F.lit(0.3), q)).otherwise(q)


def stratified_confidence(near: Column, mid: Column, far: Column, n: Column, least: int = 4) -> Column:
    q = 0.7 * position_quality(near, n) + 0.3 * rotation_quality(mid, far, n)
    return F.when(n < least, 0.0).otherwise((F.least(F.lit(1.0), n / 50.0) + q) / 2)


def stratified_noise(near: Column, mid: Column, far: Column, n: Column, mean: Column, std: Column, confidence: Column, near_limit: float = 5.0, far_limit: float = 25.0) -> tuple[Column, Column, Column]:
    """(position variance, orientation variance, cross term): the last where features are mostly far away."""
    few = F.sqrt(F.greatest(F.lit(1.0), 20.0 / n))
    scale = 1 / F.greatest(F.lit(0.1), confidence)
    p = 0.2 / F.greatest(F.lit(0.1), position_quality(near, n)) * F.when(n > 1, 1 + std / F.greatest(F.lit(0.1), mean)).otherwise(1.0) * few * scale
    o = 0.1 / F.greatest(F.lit(0.1), rotation_quality(mid, far, n)) * F.when(mean > 0, 1 / F.least(mean / near_limit, F.lit(3.0))).otherwise(1.0) * few * scale
    cross = F.when((mean > far_limit) & (far > near), F.least(mean * 0.005, F.lit(0.1))).otherwise(0.0)
    return p * p, o * o, cross


def reprojection_confidence(rmse: Column, position_std: Column, orientation_std: Column, inliers: Column, matches: Column, least: int = 4) -> Column:
    """Weighted scores that halve at 5 px, 0.5 m and 0.25 rad, plus counts, clamped to 0.01..0.95; 0 with too few inliers or without an error."""
    half = lambda v, at: F.exp(F.lit(-0.6931471806) * v / at)
    ratio = F.when(matches > 0, inliers / matches).otherwise(1.0)
    c = 0.3 * half(rmse, 5.0) + 0.3 * half(position_std, 0.5) + 0.2 * half(orientation_std, 0.25) + 0.1 * F.least(F.lit(1.0), inliers / 30.0) + 0.1 * F.least(F.lit(1.0), 10 * ratio)
    return F.when((inliers < least) | rmse.isNull() | (rmse == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.95), c)))


def distance_outlier(position: Column, angle: Column, most_m: float = 2.0, most_rad: float = 0.5) -> Column:
    return (position > most_m) | (F.abs(angle) > most_rad)


def confidence_outlier(confidence: Column, least: float = 0.3) -> Column:
    return confidence < least


def chi2_outlier(mahalanobis2: Column, confidence: Column, threshold: float = 5.348, least: float = 0.1) -> Column:
    """Squared distance beyond half the threshold over the confidence."""
    return mahalanobis2 > 0.5 * threshold / F.greatest(F.lit(least), confidence)
