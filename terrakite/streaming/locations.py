"""Matching of location fixes to positions as both arrive: the online twin of operators.asof.interpolate.

Early fixes are dropped and late ones wait, as far as the kept positions reach; so results depend
on the order of arrival, which is the order of `seq`, and a session is handled by one task; for
history at rest use operators.asof.interpolate, which has neither limit.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame

EVENT = "session_id BIGINT, seq BIGINT, kind STRING, t BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE"
RESULT = "session_id BIGINT, t BIGINT, rel_x DOUBLE, rel_y DOUBLE, rel_z DOUBLE, lat DOUBLE, lon DOUBLE, alt DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE"


class Matcher:
    """Positions (t, x, y, z) and waiting locations (t, lat, lon, alt, accuracy)."""

    def __init__(self):
        self.positions: list[tuple] = []
        self.waiting: list[tuple] = []

    def position(self, t: int, xyz: tuple) -> list[tuple]:
        self.positions.append((t, *xyz))
        return self._match()

    def location(self, t: int, where: tuple, accuracy: tuple) -> list[tuple]:
        self.waiting.append((t, *where, *accuracy))
        return self._match()

    def _match(self) -> list[tuple]:
        out = []
        while self.waiting and len(self.positions) >= 2:
            t = self.waiting[0][0]
            i = bisect_left(self.positions, t, key=lambda p: p[0])
            if i == len(self.positions):
                del self.positions[:-1]  # it waits for a position at or after it; only the last can be the one before
                break
            if i:
                pair = (i - 1, i)
            elif self.positions[0][0] == t:
                pair = (0, 1)
            else:
                pair = None  # older than every kept position
            loc = self.waiting.pop(0)
            if pair:
                a, b = self.positions[pair[0]], self.positions[pair[1]]
                share = (t - a[0]) / (b[0] - a[0]) if b[0] != a[0] else 0.5
                out.append((t, *(share * (q - p) + p for p, q in zip(a[1:], b[1:])), *loc[1:]))
                del self.positions[: pair[0]]
        return out


def _run(m: Matcher, session: int, df: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for e in df.dropna(subset=["t"]).sort_values("seq", kind="stable").itertuples():
        found = m.position(e.t, (e.x, e.y, e.z)) if e.kind == "position" else m.location(e.t, (e.x, e.y, e.z), (e.ax, e.ay, e.az)) if e.kind == "location" else []
        rows += [(session, *r) for r in found]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def match(events: DataFrame) -> DataFrame:
    """RESULT rows of EVENT rows in order of seq; a location has lat, lon, alt in x, y, z."""

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return _run(Matcher(), key[0], df)

    return events.where("session_id IS NOT NULL").groupBy("session_id").applyInPandas(one, RESULT)


def match_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """match over a stream; with `idle_ms`, a session that is silent so long in processing time is forgotten (the query then also runs batches without data)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        m = pickle.loads(state.get[0]) if state.exists else Matcher()
        out = _run(m, key[0], pd.concat(list(frames)))
        state.update((pickle.dumps(m),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield out

    return events.where("session_id IS NOT NULL").groupBy("session_id").applyInPandasWithState(step, RESULT, "matcher BINARY", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
