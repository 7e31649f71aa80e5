"""Settings of the tracker, with the checks they have to pass."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class TrackerConfig:
    filter_strategy: str = "pass_through"
    confidence_estimator: str = "reprojection"
    outlier_detector: str = "chi_squared"
    measurement_interval_seconds: float = 2.0
    initial_position_uncertainty: float = 1.0
    initial_orientation_uncertainty: float = 0.1
    outlier_threshold: float = 5.348
    base_position_noise: float = 0.2
    base_orientation_noise: float = 0.1
    landmark_position_noise: float = 0.1
    min_confidence_factor: float = 0.1
    min_inliers_for_noise: float = 20.0
    motion_position_noise_scale: float = 0.01
    motion_orientation_noise_scale: float = 0.005
    time_position_noise_scale: float = 0.001
    time_orientation_noise_scale: float = 0.0005
    max_inliers_for_confidence: float = 50.0
    spatial_distribution_scale: float = 2.0
    min_inliers_for_tracking: float = 4
    near_threshold: float = 5.0
    far_threshold: float = 25.0
    enable_anchor_constraints: bool = False
    anchor_min_confidence: float = 0.6
    anchor_min_features: int = 40
    anchor_min_spacing: float = 2.0
    anchor_max_count: int = 20
    anchor_max_distance: float = 10.0
    anchor_max_age: float = 120.0
    anchor_distance_scale: float = 5.0
    anchor_time_scale: float = 60.0
    anchor_min_relevance: float = 0.1
    anchor_max_correction: float = 0.1
    anchor_correction_strength: float = 0.2
    reprojection_expected_noise: float = 2.0
    reprojection_min_position_noise: float = 0.01
    reprojection_min_orientation_noise: float = 0.01
    sliding_window_max_keyframes: int = 10
    sliding_window_keyframe_distance: float = 0.1
    sliding_window_keyframe_angle: float = 5.0
    sliding_window_min_observations: int = 10
    sliding_window_optimization_iterations: int = 10
    sliding_window_pixel_noise: float = 2.0
    smooth_filter_alpha: float = 0.07
    smooth_filter_min_alpha: float = 0.1
    smooth_filter_motion_scale: float = 1.0
    smooth_filter_rotation_scale: float = 1.0

    #: May be 0 or less: noise scales and the two that are never checked.
    _FREE: ClassVar = ("motion_position_noise_scale", "motion_orientation_noise_scale", "time_position_noise_scale", "time_orientation_noise_scale", "spatial_distribution_scale", "smooth_filter_min_alpha")
    _SHARES: ClassVar = ("anchor_min_confidence", "anchor_min_relevance", "anchor_correction_strength", "smooth_filter_alpha")

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and not isinstance(v, bool) and f.name not in self._FREE and v <= 0:
                out.append(f"{f.name} has to be above 0")
            if f.name in self._SHARES and v > 1:
                out.append(f"{f.name} has to be at most 1")
        if self.min_inliers_for_tracking < 3:
            out.append("min_inliers_for_tracking has to be at least 3")
        if self.far_threshold <= self.near_threshold:
            out.append("far_threshold has to be above near_threshold")
        return out

    def __post_init__(self):
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))
