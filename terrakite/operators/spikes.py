"""Implausible readings in per-source series: spikes against what is usual, stuck runs and bounds.

Every source is cut into chunks with borders (chunks.py).  In a chunk positions and altitudes become residuals
against the local median of what the source's own movement leaves unexplained.  The ellipsoids of phase
space, over a residual and its first and second differences, have the robust scales of the whole source, medians
over all of its rows from a mergeable quantile sketch, so what a chunk's own level is decides nothing.
Readings outside are taken out round by round and the local median is taken again over those that stay, so that
readings that are off do not say where the others should be.  A run of up to three whose residual is then ten times the
usual size is a spike, and so is one of accuracies that are ten times the usual one, whatever is beside them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakite.operators.chunks import ordered_chunks
from terrakite.plans.stage import staged

WINDOW = 15
TIMES_USUAL = 10.0
LONGEST_SPIKE = 3
LEAST_FIXES = 5
STUCK_ROWS = 5
STUCK_MOVED_M = 2.0
HEADING_LAG = 10
#: sqrt(2 ln n) for the ellipsoid, but no more than this: then whatever is TIMES_USUAL times the usual size lies outside.
WIDEST = 6.0
#: Residuals of no more than this come from the arithmetic, where the usual one is 0.
ROUNDING_M = 1e-9
#: More readings in a row than these that are outside are no burst of spikes but a level of their own.
LONGEST_BURST = 64


def rolling_median(v: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Centred running median; shorter at the ends; NaN values are passed over."""
    if not len(v):
        return v
    pad = np.full(window // 2, np.nan)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, v, pad]), window)
    x = np.sort(views, axis=1)  # NaN goes last
    n = np.isfinite(x).sum(1)
    at = np.arange(len(v))
    lo, hi = np.maximum(n - 1, 0) // 2, n // 2
    mid = (x[at, lo] + x[at, np.minimum(hi, window - 1)]) / 2
    return np.where(n >= 3, mid, np.nan)


def differences(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second central differences of a series, real or complex."""
    if len(r) < 2:
        return np.zeros_like(r), np.zeros_like(r)
    d1 = np.gradient(r)
    return d1, np.gradient(d1)


def phase_space_outliers(r: np.ndarray, rounds: int = 10, axes: tuple[float, float, float] | None = None, again=None) -> np.ndarray:
    """Rows of the residual series `r`, real or complex, outside the ellipsoid over (r, dr, d2r).

    `axes` are its semi-axes; without them they are the universal threshold sqrt(2 ln n) times 1.4826 MAD
    of each, taken again in every round.  Outliers are replaced by 0, the local median, until no new one is found;
    `again`, if given, tells the residuals without the outliers so far.
    """
    bad = np.zeros(len(r), bool)
    if len(r) < 5 and axes is None:
        return bad
    x, lam = np.where(np.isfinite(r), r, 0.0), np.sqrt(2 * np.log(max(len(r), 2)))
    for _ in range(rounds):
        series = (x, *differences(x))
        sizes = axes or [1.4826 * lam * np.median(np.abs(v - np.median(v))) for v in series]
        away = np.zeros(len(x))
        for v, s in zip(series, sizes):
            away += (np.abs(v) / s) ** 2 if s > 0 else np.where(np.abs(v) > 0, np.inf, 0.0)
        new = (away > 1) & ~bad & np.isfinite(r)
        if not new.any():
            break
        bad |= new
        if again:
            r = again(bad)
            x = np.where(np.isfinite(r), r, 0.0)
        x = np.where(bad, 0.0, x)
    return bad


def _on_line(at: np.ndarray, v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Values at `to` of a line through `v` at `at`: the median of the slopes half of them apart, and the median of what is left."""
    if np.iscomplexobj(v):
        return _on_line(at, v.real, to) + 1j * _on_line(at, v.imag, to)
    k = len(at) // 2
    slope = np.median((v[k:] - v[: len(v) - k]) / (at[k:] - at[: len(at) - k]))
    return np.median(v - slope * at) + slope * to


def local_median(v: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Running median of a series, real or complex, of readings at the places `at`; at the ends, where it would lag behind slow changes, a line."""
    if np.iscomplexobj(v):
        return local_median(v.real, at) + 1j * local_median(v.imag, at)
    m, half = rolling_median(v), WINDOW // 2
    if len(v) >= WINDOW:
        at = np.arange(len(v)) if at is None else at
        m[:half] = _on_line(at[:WINDOW], v[:WINDOW], at[:half])
        m[-half:] = _on_line(at[-WINDOW:], v[-WINDOW:], at[-half:])
    return m


def residuals_without(v: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Residuals of the series `v`, real or complex, against the running median over the readings that are not `out`.

    A reading that is out is measured against the medians on its two sides and the line between them, at the ends a line
    through those that stay, and fits if it fits one: the edge of a step is none's spike.  More than LONGEST_BURST in a row,
    at an end more than WINDOW, stay too, as do the ends and then all where few would.
    """
    stay, n = ~out, len(v)
    ends = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).reshape(-1, 2)
    for a, b in ends:
        stay[a:b] = b - a > (WINDOW if a == 0 or b == n else LONGEST_BURST)
    if stay.sum() < 3 * WINDOW:
        for a, b in ends:
            stay[a:b] |= a == 0 or b == n
    if stay.sum() < 3:
        stay[:] = True
    i, j = np.flatnonzero(stay), np.flatnonzero(~stay)
    m, r = local_median(v[i], i), np.empty_like(v)
    r[i] = v[i] - m
    after = np.searchsorted(i, j)
    lo, hi = m[np.maximum(after - 1, 0)], m[np.minimum(after, len(i) - 1)]
    line = np.interp(j, i, m.real) + 1j * np.interp(j, i, m.imag) if np.iscomplexobj(v) else np.interp(j, i, m)
    for near, beyond in ((i[:WINDOW], j < i[0]), (i[-WINDOW:], j > i[-1])):
        line[beyond] = _on_line(near, v[near], j[beyond])
    d = v[j] - np.stack([line, lo, hi])
    r[j] = np.take_along_axis(d, np.abs(d).argmin(0)[None], 0)[0]
    return r


def settled_residuals(v: np.ndarray, axes: tuple[float, float, float]) -> np.ndarray:
    """Residuals of the series `v`, real or complex, against the running median over what is inside the ellipsoid with `axes`."""
    r = v - local_median(v)
    bad = phase_space_outliers(r, len(v), axes, lambda out: residuals_without(v, out))
    return residuals_without(v, bad) if bad.any() else r


def heading(z: np.ndarray, w: np.ndarray) -> complex:
    """The rotation (unit complex) that turns movement w into change of position z, robust to outliers.

    Each step over HEADING_LAG readings votes with its direction only; a least-squares fit over the
    steps that agree with the vote refines it.
    """
    k = min(HEADING_LAG, len(z) // 2)
    if k < 1:
        return 1.0 + 0j
    dz, dw = z[k:] - z[:-k], w[k:] - w[:-k]
    far = (np.abs(dw) > 0) & (np.abs(dz) > 0)
    far &= np.abs(dw) >= np.median(np.abs(dw)) / 2
    dz, dw = dz[far], dw[far]
    if not len(dz):
        return 1.0 + 0j
    vote = (dz / np.abs(dz) * np.conj(dw / np.abs(dw))).mean()
    rot = vote / abs(vote) if abs(vote) > 0 else 1.0 + 0j
    for _ in range(3):
        off = np.abs(dz - rot * dw)
        near = off <= 3 * np.median(off)
        fit = (dz[near] * np.conj(dw[near])).sum()
        rot = fit / abs(fit) if abs(fit) > 0 else rot
    return rot


def stuck_runs(lat: np.ndarray, lon: np.ndarray, moved: np.ndarray, rows: int = STUCK_ROWS, least: float = STUCK_MOVED_M) -> np.ndarray:
    """Rows that repeat the position before them in a run of `rows` or more during which `moved` (n x 3) went `least` or farther."""
    n = len(lat)
    same = np.zeros(n, bool)
    same[1:] = (lat[1:] == lat[:-1]) & (lon[1:] == lon[:-1])
    run = np.cumsum(~same) - 1
    out = np.zeros(n, bool)
    if not n:
        return out
    first = np.flatnonzero(~same)
    size = np.bincount(run)
    d = np.linalg.norm(moved - moved[first[run]], axis=1)
    most = np.full(len(size), 0.0)
    np.maximum.at(most, run, np.where(np.isfinite(d), d, 0.0))
    return same & (size >= rows)[run] & (most >= least)[run]


def end_runs(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """1 for the rows of the first run of equal positions, 2 for those of the last if it is another, 0 between them."""
    if not len(lat):
        return np.zeros(0, int)
    run = np.concatenate([[0], np.cumsum((lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1]))])
    return np.where(run == 0, 1, np.where(run == run[-1], 2, 0))


_COLUMNS = ["lat", "lon", "alt", "rx", "ry", "rz", "ax", "ay"]
_OUT = "gps_id bigint, source bigint, pos double, east double, north double, alt double, high double, ax double, ay double, steps array<float>, impossible boolean, stuck boolean, own boolean, chunk bigint, end int, lat double, lon double, rx double, ry double, rz double"


def _first_in_batch(batches):
    """Leaves one copy of a key in each batch, so that a key with very many copies is thinned before the shuffle."""
    for b in batches:
        t = pa.Table.from_batches([b])
        _, at = np.unique(t.column("gps_id").to_numpy(), return_index=True)
        yield from t.take(pa.array(np.sort(at))).to_batches()


_LOCAL, _SESSION_WIDE = ("pos", "alt"), ("ax", "ay")
_KINDS = _LOCAL + _SESSION_WIDE


def short_runs(has: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Values that are `over` in a run of at most LONGEST_SPIKE that are; rows without a value are passed over."""
    out, at = np.zeros(len(has), bool), np.flatnonzero(has)
    if len(at):
        o = over[at]
        run = np.cumsum(np.concatenate([[False], o[1:] != o[:-1]]))
        out[at] = o & (np.bincount(run) <= LONGEST_SPIKE)[run]
    return out


def _chunk_spikes(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("gps_id", kind="stable")
    levels, hit = df["levels"].to_numpy(), np.zeros(len(df), bool)
    for i in range(len(_SESSION_WIDE)):
        level = levels // 3**i % 3
        hit |= short_runs(level > 0, level == 2)
    scales = np.asarray(df["scales"].iloc[0], np.float64).reshape(len(_LOCAL), 4)
    for v, (limit, *axes) in zip((df["east"].to_numpy(np.float64) + 1j * df["north"].to_numpy(np.float64), df["high"].to_numpy(np.float64)), scales):
        has, over = np.isfinite(v), np.zeros(len(df), bool)
        if limit < np.inf:
            size = np.abs(settled_residuals(v[has], axes))
            over[has] = (size > ROUNDING_M) & (size >= limit)
            hit |= short_runs(has, over)
    return pd.DataFrame({"gps_id": df["gps_id"].to_numpy()[hit & df["own"].to_numpy(bool)]})


def _chunk_residuals(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values(["gps_id", *_COLUMNS], kind="stable").drop_duplicates("gps_id")
    n = len(df)
    lat, lon, alt, rx, ry, rz, ax, ay = (df[c].to_numpy(np.float64, na_value=np.nan) for c in _COLUMNS)
    there = df["here"].to_numpy(bool)
    no_pos = df["bad_pos"].to_numpy(bool) | ~np.isfinite(lat) | ~np.isfinite(lon)
    (east, north, pos, high, alt_r), z_r, stuck = np.full((5, n), np.nan), np.full(n, np.nan + 0j), np.zeros(n, bool)

    ok = np.flatnonzero(~no_pos & np.isfinite(rx) & np.isfinite(rz))
    if len(ok) >= 3:
        lat0, lon0 = np.median(lat[ok]), np.median(lon[ok])
        x = (np.mod(lon[ok] - lon0 + 180, 360) - 180) * 111_320.0 * np.cos(np.radians(lat0))
        z, w = x + 1j * (lat[ok] - lat0) * 110_574.0, rx[ok] - 1j * rz[ok]
        left = z - heading(z, w) * w
        east[ok], north[ok], z_r[ok] = left.real, left.imag, left - local_median(left)
        pos[ok] = np.abs(z_r[ok])
    ok = np.flatnonzero(np.isfinite(alt) & (np.abs(alt) <= 9000) & np.isfinite(ry))
    if len(ok) >= 3:
        high[ok] = alt[ok] - ry[ok]
        alt_r[ok] = high[ok] - local_median(high[ok])
    own = df["_own"].to_numpy(bool)
    fixed, end = np.flatnonzero(there & own), np.zeros(n, int)
    end[fixed] = end_runs(lat[fixed], lon[fixed])
    stuck[fixed] = stuck_runs(lat[fixed], lon[fixed], np.stack([rx, ry, rz], 1)[fixed]) & (end[fixed] == 0)
    at_end = lambda v: np.where(end > 0, v, np.nan)
    good = lambda v: np.where((v > 0) & (v <= 1e6), v, np.nan)
    steps = np.full((n, 2 * len(_LOCAL)), np.nan, np.float32)
    for i, v in enumerate((z_r, alt_r)):
        has = np.flatnonzero(np.isfinite(v))
        d1, d2 = differences(v[has])
        steps[has, 2 * i], steps[has, 2 * i + 1] = np.abs(d1), np.abs(d2)
    return pd.DataFrame(
        {
            "gps_id": df["gps_id"].to_numpy(), "source": df["source"].to_numpy(), "pos": pos, "east": east, "north": north, "alt": alt_r, "high": high, "ax": good(ax), "ay": good(ay), "steps": list(steps), "impossible": df["impossible"].to_numpy(bool), "stuck": stuck, "own": own,
            "chunk": key[1], "end": end, "lat": at_end(lat), "lon": at_end(lon), "rx": at_end(rx), "ry": at_end(ry), "rz": at_end(rz),
        }
    )


def stuck_across(each: DataFrame) -> DataFrame:
    """(gps_id) of stuck rows in the runs at the ends of the chunks, each run judged whole over all chunks it goes through.

    The runs at the ends, two rows a chunk, are joined to those they go on from; then the rows of the
    long ones are measured from the first row of the whole run, and each chunk is told the verdict.
    """
    here = ["source", "chunk", "end"]
    rows = each.where("end > 0").select(*here, "gps_id", "lat", "lon", F.struct("rx", "ry", "rz").alias("at"))
    ends = rows.groupBy(*here).agg(F.count("*").alias("n"), F.min("gps_id").alias("first"), F.min_by(F.struct("lat", "lon", "at"), "gps_id").alias("v")).select(*here, "n", "first", "v.*")
    w = Window.partitionBy("source").orderBy("first")
    goes_on = (F.col("end") == 1) & (F.col("lat") == F.lag("lat").over(w)) & (F.col("lon") == F.lag("lon").over(w)) & ~F.isnan("lat") & ~F.isnan("lon")
    runs = ends.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(w))
    whole = runs.groupBy("source", "run").agg(F.sum("n").alias("rows"), F.min("first").alias("first_id"), F.min_by("at", "first").alias("from")).where(F.col("rows") >= STUCK_ROWS)
    parts = staged(runs.select(*here, "run").join(whole, ["source", "run"]), "runs")
    d = F.sqrt(sum((F.col(f"at.{c}") - F.col(f"from.{c}")) * (F.col(f"at.{c}") - F.col(f"from.{c}")) for c in ("rx", "ry", "rz")))
    far = rows.join(parts, here).groupBy("source", "run").agg(F.max(F.when(~F.isnan(d) & (d < float("inf")), d)).alias("most")).where(F.col("most") >= STUCK_MOVED_M)
    verdict = parts.join(far.select("source", "run"), ["source", "run"]).select(*here, "first_id")
    return rows.join(verdict, here).where(F.col("gps_id") != F.col("first_id")).select("gps_id")


def implausible_fixes(gps: DataFrame, chunk_rows: int = 8192, halo: int = 512) -> DataFrame:
    """(gps_id, reason) of fixes that cannot be true readings of their session.

    `gps` needs gps_id, session_id, relative, global and accuracy; other columns are ignored.
    `impossible`: a value that cannot be real.  `spike`: position or altitude at least TIMES_USUAL times as far as
    usual from where those in the ellipsoids put it, or accuracy at least TIMES_USUAL times the session's usual one, for
    at most LONGEST_SPIKE fixes in a row.  `stuck`: a
    repeated position in a run of STUCK_ROWS or more while the device moved.  A fix can have several
    reasons, each once.  Nulls are no case; a fix without a session can only be `impossible`; copies
    of a key count once; rows without a key are left out; an empty table gives no rows.  Runs of equal
    positions are judged whole, however many chunks they go through.
    """
    el = lambda c, i: F.get(F.col(f"`{c}`"), F.lit(i)).cast("double")
    lat, lon, alt, ax, ay = el("global", 0), el("global", 1), el("global", 2), el("accuracy", 0), el("accuracy", 1)
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    bad_pos = odd(lat) | odd(lon) | yes(F.abs(lat) > 90) | yes(F.abs(lon) > 180) | yes((lat == 0) & (lon == 0))
    az = el("accuracy", 2)
    bad = bad_pos | odd(alt) | yes(F.abs(alt) > 9000) | odd(ax) | odd(ay) | odd(az) | yes(ax <= 0) | yes(ay <= 0) | yes(ax > 1e6) | yes(ay > 1e6)
    flat = gps.where("gps_id IS NOT NULL").select(
        F.col("gps_id").cast("long").alias("gps_id"), F.col("session_id").cast("long").alias("source"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt"),
        el("relative", 0).alias("rx"), el("relative", 1).alias("ry"), el("relative", 2).alias("rz"), ax.alias("ax"), ay.alias("ay"), bad.alias("impossible"), bad_pos.alias("bad_pos"), (lat.isNotNull() & lon.isNotNull()).alias("here"),
    )
    thin = flat.where("source IS NOT NULL").mapInArrow(_first_in_batch, flat.schema)
    counted = gps.where("gps_id IS NOT NULL AND session_id IS NOT NULL").select(F.col("gps_id").cast("long").alias("gps_id"), F.col("session_id").cast("long").alias("source"))
    parts = ordered_chunks(thin, "source", "gps_id", chunk_rows, halo, counted=counted)
    seen = staged(parts.groupBy("source", "_chunk").applyInPandas(_chunk_residuals, _OUT), "residuals")
    each = seen.where("own")
    there = lambda c: F.when(~F.isnan(c), c)
    size = lambda c: there(F.abs(c))
    step = [there(F.get("steps", F.lit(i))) for i in range(2 * len(_LOCAL))]
    usual = each.groupBy("source").agg(
        *[F.percentile_approx(F.when(F.col(c) > 0, F.col(c)) if c in ("ax", "ay") else size(F.col(c)), 0.5, 10_000).alias(f"u_{c}") for c in _KINDS], *[F.count(there(F.col(c))).alias(f"n_{c}") for c in _KINDS],
        F.array(*[F.coalesce(F.percentile_approx(v, 0.5, 1000).cast("double"), F.lit(0.0)) for v in step]).alias("u_steps"),
    )
    # of each accuracy: 0 none, 1 one, 2 one of TIMES_USUAL times the usual or more
    level = lambda c: F.when(size(F.col(c)).isNull(), 0).when(size(F.col(c)) >= TIMES_USUAL * F.col(f"u_{c}"), 2).otherwise(1)
    # of positions and altitudes: how far off is a spike, which fewer than LEAST_FIXES do not tell, and the semi-axes; where the usual residual is 0, any other is outside
    limit = lambda c: F.when(F.col(f"n_{c}") >= LEAST_FIXES, TIMES_USUAL * F.col(f"u_{c}")).otherwise(F.lit(float("inf")))
    axes = lambda i, c: [1.4826 * F.least(F.lit(WIDEST), F.sqrt(2 * F.log(F.greatest(F.col(f"n_{c}"), F.lit(2))))) * F.coalesce(u, F.lit(0.0)) for u in (F.col(f"u_{c}"), F.get("u_steps", F.lit(2 * i)), F.get("u_steps", F.lit(2 * i + 1)))]
    levels = seen.join(usual, "source").select(
        "source", "chunk", "gps_id", "own", "east", "north", "high", sum(level(c) * 3**i for i, c in enumerate(_SESSION_WIDE)).cast("int").alias("levels"),
        F.array(*[v for i, c in enumerate(_LOCAL) for v in (limit(c), *axes(i, c))]).alias("scales"),
    )
    spikes = levels.groupBy("source", "chunk").applyInPandas(_chunk_spikes, "gps_id bigint")
    impossible = flat.where("impossible").select("gps_id", F.lit("impossible").alias("reason")).distinct()
    return (
        impossible.unionByName(spikes.select("gps_id", F.lit("spike").alias("reason")))
        .unionByName(each.where("stuck").select("gps_id").unionByName(stuck_across(each)).withColumn("reason", F.lit("stuck")))
    )


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Fixes with an implausible position or accuracy."""
    from terrakite.plans.stage import table

    return implausible_fixes(table(spark, sf_dir, "gps")).select("gps_id").distinct()


def p3_impossible(spark, sf_dir: str) -> DataFrame:
    """Fixes with a value that cannot be real."""
    from terrakite.plans.stage import table

    return implausible_fixes(table(spark, sf_dir, "gps")).where("reason = 'impossible'").select("gps_id").distinct()


def p3_stuck(spark, sf_dir: str) -> DataFrame:
    """Fixes that repeat the position before them while the device moved."""
    from terrakite.plans.stage import table

    return implausible_fixes(table(spark, sf_dir, "gps")).where("reason = 'stuck'").select("gps_id").distinct()


_PARTS = 'SELECT gps_id, session_id, received_at, "global"[1] AS lat, "global"[2] AS lon, "global"[3] AS alt, accuracy[1] AS ax, accuracy[2] AS ay, accuracy[3] AS az, relative[1] AS rx, relative[2] AS ry, relative[3] AS rz FROM gps WHERE gps_id IS NOT NULL'
IMPOSSIBLE_SQL = f"""WITH g AS ({_PARTS}) SELECT DISTINCT gps_id FROM g WHERE NOT isfinite(lat) OR NOT isfinite(lon) OR NOT isfinite(alt) OR NOT isfinite(ax) OR NOT isfinite(ay) OR NOT isfinite(az)
 OR abs(lat) > 90 OR abs(lon) > 180 OR (lat = 0 AND lon = 0) OR abs(alt) > 9000 OR ax <= 0 OR ay <= 0 OR ax > 1e6 OR ay > 1e6"""
STUCK_SQL = f"""WITH g AS ({_PARTS}), o AS (SELECT * FROM g WHERE session_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gps_id ORDER BY received_at) = 1),
 c AS (SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w, false) AS same FROM o WINDOW w AS (PARTITION BY session_id ORDER BY gps_id)),
 r AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY session_id ORDER BY gps_id) AS run FROM c),
 f AS (SELECT *, count(*) OVER w AS n, first_value(rx) OVER o AS x0, first_value(ry) OVER o AS y0, first_value(rz) OVER o AS z0 FROM r WINDOW w AS (PARTITION BY session_id, run), o AS (PARTITION BY session_id, run ORDER BY gps_id)),
 d AS (SELECT *, max(sqrt((rx - x0) * (rx - x0) + (ry - y0) * (ry - y0) + (rz - z0) * (rz - z0))) OVER (PARTITION BY session_id, run) AS far FROM f) SELECT gps_id FROM d WHERE same AND n >= {STUCK_ROWS} AND far >= {STUCK_MOVED_M}"""
