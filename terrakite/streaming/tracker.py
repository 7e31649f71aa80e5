"""Fusion of device motion and localizations into one map-to-device transform per device.

One state machine, run over a batch (track) or a stream (track_stream); both give the same rows
for the same order of events.  Time is event time.
"""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terrakite.functions import se3
from terrakite.streaming.config import TrackerConfig
from terrakite.streaming.filters import make_filter
from terrakite.streaming.measurement import DETECTORS, ESTIMATORS, INLIER_FIELDS, Measurement

EVENT = (
    "device BIGINT, seq BIGINT, t BIGINT, kind STRING, pose ARRAY<DOUBLE>, captured BIGINT, total_matches INT, intrinsics ARRAY<DOUBLE>, "
    "inliers ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, u: DOUBLE, v: DOUBLE, size: DOUBLE, response: DOUBLE, octave: INT>>"
)
RESULT = "device BIGINT, seq BIGINT, t BIGINT, kind STRING, success BOOLEAN, confidence DOUBLE, outlier BOOLEAN, streak INT, restarted BOOLEAN, map_to_device ARRAY<DOUBLE>, pose ARRAY<DOUBLE>, uncertainty DOUBLE"
HISTORY = 512  # device poses kept to find the one at which a picture was taken
BAD_STREAK, BAD_CONFIDENCE = 3, 0.4


class Tracker:
    """The state of one device.

    vio: a device pose; every one after the first also predicts.  located: a localization, carried
    forward by the device's motion since its picture was taken, then tested and fused.  reset: forget
    everything but the count of rejections.
    """

    def __init__(self, config: TrackerConfig):
        self.config = config
        self.filter = make_filter(config.filter_strategy)
        self.estimator, self.detector = ESTIMATORS[config.confidence_estimator](), DETECTORS[config.outlier_detector]()
        self.streak = 0
        self._forget()

    def _forget(self):
        self.last = self.now = None
        self.past: deque = deque(maxlen=HISTORY)
        self.predicted_at: int | None = None
        self.transform = np.eye(4)

    def vio(self, t: int, pose: np.ndarray, unit: float) -> bool:
        """False if the pose is no rigid transform."""
        if not se3.valid_np(pose):
            return False
        self.last, self.now = (self.now if self.now is not None else pose), pose
        self.past.append((t, pose))
        dt = 0.0 if self.predicted_at is None else (t - self.predicted_at) * unit
        self.predicted_at = t if self.predicted_at is None else max(t, self.predicted_at)
        if self.filter.ready and dt > 0:
            motion = se3.inverse_np(self.last) @ self.now
            self.filter.predict(motion if se3.valid_np(motion) else np.eye(4), dt, self.config)
        return True

    def located(self, m: Measurement, captured: int | None) -> dict:
        out = {"success": False, "outlier": False, "restarted": False}
        if not se3.valid_np(m.pose):
            return out
        if captured is not None and self.past:
            then = next((p for t, p in reversed(self.past) if t <= captured), self.past[0][1])
            moved = se3.inverse_np(then) @ self.now
            if se3.valid_np(moved):
                m.pose = m.pose @ moved
        m.confidence = self.estimator.confidence(m, self.config)
        m.noise = self.estimator.noise(m, self.config)
        out |= {"success": True, "confidence": m.confidence}
        if not self.filter.ready:
            self.filter.start(m, self.config)
        else:
            far = self.detector.outlier(m.pose, self.filter.pose(), self.filter.covariance(), m.confidence, self.config)
            self.streak = self.streak + 1 if far else 0
            lost = far and self.streak >= BAD_STREAK and m.confidence > BAD_CONFIDENCE
            if lost:
                self.filter = make_filter(self.config.filter_strategy)
                self.filter.start(m, self.config)
                out["restarted"] = True
            elif far:
                return out | {"outlier": True}
            self.filter.update(m, self.config)
        if self.now is not None:
            t = self.now @ se3.inverse_np(self.filter.pose())
            if se3.valid_np(t):
                self.transform = t
        return out

    def handle(self, e: dict, unit: float) -> dict:
        """The result row of one event.  Rows of another kind, or without time, do nothing."""
        out = {"success": False, "confidence": None, "outlier": False, "restarted": False}
        pose = _matrix(e.get("pose"))
        if e["kind"] == "vio" and pose is not None:
            out["success"] = self.vio(int(e["t"]), pose, unit)
        elif e["kind"] == "located" and pose is not None:
            k = e.get("intrinsics")
            k = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0] if k is None or len(k) < 9 else k
            rows = e.get("inliers")
            inl = np.array([[float(r[f] if r[f] is not None else 0.0) for f in INLIER_FIELDS] for r in (rows if rows is not None else [])], float).reshape(-1, len(INLIER_FIELDS))
            total = e.get("total_matches")
            m = Measurement(pose, inl, int(total) if total is not None and total == total else len(inl), (float(k[0]), float(k[4])), (float(k[6]), float(k[7])), float(e["t"]) * unit)
            captured = e.get("captured")
            out |= self.located(m, None if captured is None or captured != captured else int(captured))
        elif e["kind"] == "reset":
            self.filter = make_filter(self.config.filter_strategy)
            self._forget()
            out["success"] = True
        ready = self.filter.ready
        out |= {
            "streak": self.streak,
            "map_to_device": self.transform.ravel(order="F").tolist() if e["kind"] == "located" else (self.now @ se3.inverse_np(self.filter.pose())).ravel(order="F").tolist() if ready and self.now is not None else None,
            "pose": self.filter.pose().ravel(order="F").tolist() if ready else None,
            "uncertainty": float(self.filter.uncertainty()) if ready else float("inf"),
        }
        return {k: e[k] for k in ("device", "seq", "t", "kind")} | out


def _matrix(v) -> np.ndarray | None:
    if v is None or (isinstance(v, float)) or len(v) != 16 or any(x is None for x in v):
        return None
    return np.array(v, float).reshape(4, 4, order="F")


_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _run(tracker: Tracker, events: pd.DataFrame, unit: float) -> pd.DataFrame:
    """Events in order of t, then seq."""
    rows = [tracker.handle(e, unit) for e in events.dropna(subset=["t"]).sort_values(["t", "seq"], kind="stable").to_dict("records")]
    return pd.DataFrame(rows, columns=_NAMES)


def track(events: DataFrame, config: TrackerConfig = TrackerConfig(), unit: float = 1e-6) -> DataFrame:
    """RESULT rows of EVENT rows, every device by itself.  `unit`: seconds a tick of t.  Filters are sequential, so a device is one group."""

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return _run(Tracker(config), df, unit)

    return events.where("device IS NOT NULL").groupBy("device").applyInPandas(one, RESULT)


def track_stream(events: DataFrame, config: TrackerConfig = TrackerConfig(), unit: float = 1e-6, idle_ms: int | None = None) -> DataFrame:
    """track over a stream of EVENT rows; with `idle_ms`, a device that is silent so long in processing time is forgotten (the query then also runs batches without data)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(config)
        out = _run(tracker, pd.concat(list(frames)), unit)
        state.update((pickle.dumps(tracker),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield out

    return events.where("device IS NOT NULL").groupBy("device").applyInPandasWithState(step, RESULT, "tracker BINARY", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
