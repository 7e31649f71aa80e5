"""Queries over the map-shaped views: one per operator, with the SQL that checks it.

Floating results are rounded in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakite.functions import camera, confidence, geo, se3
from terrakite.functions import rects as rc
from terrakite.functions.rects import Rect
from terrakite.operators import aggregates as ag
from terrakite.operators import alignment, asof, graph, mapedit, matching, spatial
from terrakite.plans.views import CENTRE_X, CENTRE_Y, FOCAL, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUERY_RECT = (20.0, 20.0, 60.0, 60.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


# --- range queries -------------------------------------------------------------------------------------------------

_TOUCH = "lx <= 60 AND 20 <= ux AND lz <= 60 AND 20 <= uz"


@query(f"SELECT id, x, z, sightings FROM fx_landmarks WHERE {_TOUCH}")
def spatial_find(spark, d):
    return spatial.find(view(spark, d, "fx_landmarks"), Rect.of(*QUERY_RECT)).select("id", "x", "z", "sightings")


@query(f"SELECT id, x, z, sightings FROM fx_landmarks WHERE {_TOUCH} ORDER BY sightings DESC, id LIMIT 50")
def spatial_find_topk(spark, d):
    return spatial.find(view(spark, d, "fx_landmarks"), Rect.of(*QUERY_RECT), 50).select("id", "x", "z", "sightings")


def _pairs(spark, d) -> DataFrame:
    f = view(spark, d, "fx_frames").select("frame_id", "cx", "cz")
    return spatial.range_join(f, view(spark, d, "fx_landmarks"), spatial.query_square(F.col("cx"), F.col("cz"), 4.0), Rect.named(), 8.0, "frame_id", "id")


_PAIRS = "fx_frames f JOIN fx_landmarks l ON l.lx <= f.cx + 2 AND f.cx - 2 <= l.ux AND l.lz <= f.cz + 2 AND f.cz - 2 <= l.uz"


@query(f"SELECT frame_id, id FROM {_PAIRS}")
def spatial_range_join(spark, d):
    return _pairs(spark, d).select("frame_id", "id")


@query(f"SELECT frame_id, id, sightings FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY sightings DESC, id) <= 3")
def spatial_topk_per_query(spark, d):
    f = view(spark, d, "fx_frames").select("frame_id", "cx", "cz")
    return spatial.top_range_join(f, view(spark, d, "fx_landmarks"), "frame_id", "id", spatial.query_square(F.col("cx"), F.col("cz"), 4.0), Rect.named(), 8.0, 3)


@query("SELECT id, sightings FROM fx_landmarks ORDER BY sightings DESC, id LIMIT 262143")
def candidates_without_filter(spark, d):
    return spatial.candidates(view(spark, d, "fx_landmarks"), 0.0, 0.0, 0.0).select("id", "sightings")


@query("SELECT id, x, z FROM fx_landmarks WHERE id = 7")
def landmark_lookup(spark, d):
    return spatial.lookup(view(spark, d, "fx_landmarks"), "id", 7).select("id", "x", "z")


@query("SELECT count(*) AS n FROM fx_landmarks")
def landmark_count(spark, d):
    return view(spark, d, "fx_landmarks").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT max(id) AS top FROM fx_landmarks) SELECT id, x FROM fx_landmarks
 UNION ALL SELECT top + row_number() OVER (ORDER BY x, y, z), x FROM (SELECT DISTINCT x, y, z FROM fx_landmarks) n, m""")
def landmark_insert(spark, d):
    rows = view(spark, d, "fx_landmarks").select("id", "x", "y", "z")
    new = rows.select("x", "y", "z").distinct().withColumn("id", F.lit(0).cast("long")).withColumn("o", F.struct("x", "y", "z"))
    return spatial.insert(rows.withColumn("o", F.struct("x", "y", "z")), new, order="o").select("id", "x")


@query("SELECT id FROM fx_landmarks WHERE id % 3 <> 0")
def landmark_erase(spark, d):
    l = view(spark, d, "fx_landmarks")  # noqa: E741
    return spatial.erase(l, l.where("id % 3 = 0")).select("id")


@query("SELECT id, round(CASE WHEN id % 3 = 0 THEN lx - 1 ELSE lx END, 6) AS lx, round(uz, 6) AS uz FROM fx_landmarks")
def landmark_update_bounds(spark, d):
    l = view(spark, d, "fx_landmarks")  # noqa: E741
    new = l.where("id % 3 = 0").withColumn("lx", F.col("lx") - 1)
    return spatial.update_bounds(l, new).select("id", r(F.col("lx")).alias("lx"), r(F.col("uz")).alias("uz"))


@query("""SELECT a.id AS a, b.id AS b,
 (a.lx <= b.ux AND b.lx <= a.ux AND a.lz <= b.uz AND b.lz <= a.uz) AS touches, (a.lx > b.lx AND a.lz > b.lz AND a.ux < b.ux AND a.uz < b.uz) AS within,
 round((greatest(a.ux, b.ux) - least(a.lx, b.lx)) * (greatest(a.uz, b.uz) - least(a.lz, b.lz)), 6) AS union_area, round((a.ux - a.lx) * (a.uz - a.lz), 6) AS area,
 round((least(a.ux, b.ux) - greatest(a.lx, b.lx)) * (least(a.uz, b.uz) - greatest(a.lz, b.lz)), 6) AS overlap, round((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z), 6) AS dist2, round(a.x + a.z, 6) AS l1
 FROM fx_landmarks a JOIN fx_landmarks b ON b.id = a.id + 1""")
def rect_metrics(spark, d):
    cols = ["id", "x", "z", "lx", "lz", "ux", "uz"]
    a = view(spark, d, "fx_landmarks").select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = view(spark, d, "fx_landmarks").select(*[F.col(c).alias(f"b_{c}") for c in cols])
    p, q = Rect.named("a_"), Rect.named("b_")
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), rc.intersects(p, q).alias("touches"), rc.inside(p, q).alias("within"), r(rc.area(rc.union_box(p, q))).alias("union_area"), r(rc.area(p)).alias("area"),
        r(rc.overlap(p, q)).alias("overlap"), r(rc.squared_distance(F.col("a_x"), F.col("a_z"), F.col("b_x"), F.col("b_z"))).alias("dist2"), r(rc.l1(F.col("a_x"), F.col("a_z"))).alias("l1"),
    )


# --- landmarks and frames ------------------------------------------------------------------------------------------


@query("SELECT id, sightings FROM fx_landmarks WHERE sightings >= 3")
def usable_landmarks(spark, d):
    return ag.usable(view(spark, d, "fx_landmarks")).select("id", "sightings")


def _seen(spark, d) -> DataFrame:
    o = view(spark, d, "fx_observations").select(F.col("landmark_id").alias("id"), "frame_id", "seq")
    f = view(spark, d, "fx_frames").select("frame_id", "cx", "cy", "cz", "t")
    return o.join(f, "frame_id").withColumn("order", F.struct("t", "frame_id", "seq"))


_SEEN = "seen AS (SELECT l.*, f.cx, f.cy, f.cz, f.t, o.frame_id, o.seq, sqrt((f.cx - l.x) * (f.cx - l.x) + (f.cy - l.y) * (f.cy - l.y) + (f.cz - l.z) * (f.cz - l.z)) AS far FROM fx_landmarks l JOIN fx_observations o ON o.landmark_id = l.id JOIN fx_frames f ON f.frame_id = o.frame_id)"
_BOX = "round({0}lx, 6) AS lx, round({0}lz, 6) AS lz, round({0}ux, 6) AS ux, round({0}uz, 6) AS uz"


def _box(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *[r(F.col(c)).alias(c) for c in ("lx", "lz", "ux", "uz")], *more)


@query(f"""WITH {_SEEN}, g AS (SELECT id, greatest(3, 0.2 * max(far)) AS m, min(cx) AS x0, max(cx) AS x1, min(cz) AS z0, max(cz) AS z1 FROM seen GROUP BY id),
 b AS (SELECT l.id, coalesce(x0 - m, x - 1) AS lx, coalesce(z0 - m, z - 1) AS lz, coalesce(x1 + m, x + 1) AS ux, coalesce(z1 + m, z + 1) AS uz FROM fx_landmarks l LEFT JOIN g USING (id)) SELECT id, {_BOX.format('')} FROM b""")
def landmark_bounds_cpp(spark, d):
    return _box(ag.camera_bounds(view(spark, d, "fx_landmarks"), _seen(spark, d)))


@query(f"""WITH {_SEEN}, g AS (SELECT id, 0.1 * max(far) AS m, min(cx) AS x0, max(cx) AS x1, min(cz) AS z0, max(cz) AS z1 FROM seen GROUP BY id),
 b AS (SELECT l.id, coalesce(least(x0, x) - m, x - 1) AS lx, coalesce(least(z0, z) - m, z - 1) AS lz, coalesce(greatest(x1, x) + m, x + 1) AS ux, coalesce(greatest(z1, z) + m, z + 1) AS uz FROM fx_landmarks l LEFT JOIN g USING (id))
 SELECT id, {_BOX.format('')} FROM b""")
def landmark_bounds_py(spark, d):
    return _box(ag.camera_bounds(view(spark, d, "fx_landmarks"), _seen(spark, d), margin=0.1, floor=0.0, include_landmark=True))


@query(f"""WITH {_SEEN}, h AS (SELECT *, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS hd FROM seen),
 b AS (SELECT id, min(cx - hd) AS lx, min(cz - hd) AS lz, max(cx + hd) AS ux, max(cz + hd) AS uz, count(*) AS sightings, max(t) AS last_seen FROM h GROUP BY id) SELECT id, {_BOX.format('')}, sightings, last_seen FROM b""")
def landmark_bounds_incremental(spark, d):
    return _box(ag.recorded_observations(view(spark, d, "fx_landmarks"), _seen(spark, d), order="order"), "sightings", "last_seen")


@query("""SELECT frame_id, n FROM (SELECT o.frame_id, count(*) AS n FROM fx_observations o JOIN fx_landmarks l ON l.id = o.landmark_id WHERE l.sightings >= 3 GROUP BY 1) q ORDER BY n DESC, frame_id LIMIT 1""")
def most_connected_pose(spark, d):
    return ag.most_connected_frame(view(spark, d, "fx_observations"), view(spark, d, "fx_landmarks"))


@query("""SELECT frame_id, count(*) AS landmarks, count(*) FILTER (sightings >= 3) AS usable FROM (SELECT DISTINCT frame_id, landmark_id FROM fx_observations) o JOIN fx_landmarks l ON l.id = o.landmark_id GROUP BY 1""")
def frame_stats(spark, d):
    return ag.frame_stats(view(spark, d, "fx_observations"), view(spark, d, "fx_landmarks"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM fx_frames), p AS (SELECT a.session_id, a.frame_id AS a, b.frame_id AS b, sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cz - a.cz) * (b.cz - a.cz)) AS dist
 FROM f a JOIN f b ON a.session_id = b.session_id AND b.n = a.n + 1) SELECT session_id, a, b, round(dist, 6) AS dist, round(1 / (greatest(0.1, dist) * greatest(0.1, dist)) / 0.04, 6) AS info_t,
 round(1 / (greatest(0.1, dist) * greatest(0.1, dist)) / ((10 * pi() / 180) * (10 * pi() / 180)), 6) AS info_r FROM p""")
def odometry_information(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "frame_id")
    nxt = F.lead(F.struct("frame_id", "cx", "cz")).over(w)
    p = view(spark, d, "fx_frames").withColumn("n", nxt).where("n IS NOT NULL")
    dist = F.sqrt((F.col("n.cx") - F.col("cx")) * (F.col("n.cx") - F.col("cx")) + (F.col("n.cz") - F.col("cz")) * (F.col("n.cz") - F.col("cz")))
    s = F.greatest(F.lit(0.1), dist)
    return p.select("session_id", F.col("frame_id").alias("a"), F.col("n.frame_id").alias("b"), r(dist).alias("dist"), r(1 / (s * s) / 0.04).alias("info_t"), r(1 / (s * s) / float((10 * 3.141592653589793 / 180) ** 2)).alias("info_r"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM fx_frames), p AS (SELECT least(a.frame_id, b.frame_id) + 1 AS lo, greatest(a.frame_id, b.frame_id) + 1 AS hi
 FROM f a JOIN f b ON a.session_id = b.session_id AND b.n = a.n + 1) SELECT lo * 2147483647 + hi AS pair_id FROM p WHERE lo % 5 <> 0 """)
def two_view_pairs_insert(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "frame_id")
    p = view(spark, d, "fx_frames").withColumn("n", F.lead("frame_id").over(w)).where("n IS NOT NULL")
    ids = p.select(camera.pair_id(F.col("frame_id") + 1, F.col("n") + 1).alias("pair_id"), F.least(F.col("frame_id") + 1, F.col("n") + 1).alias("lo"))
    stored = ids.where("lo % 5 = 0").select("pair_id")
    return ids.select("pair_id").join(stored, "pair_id", "left_anti")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM fx_frames), p AS (SELECT sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cz - a.cz) * (b.cz - a.cz)) AS dev, abs(b.cx - a.cx) + abs(b.cz - a.cz) AS opt
 FROM f a JOIN f b ON a.session_id = b.session_id AND b.n = a.n + 1), q AS (SELECT dev / opt AS v, row_number() OVER (ORDER BY dev / opt) - 1 AS i, count(*) OVER () AS n FROM p WHERE dev > 0.1 AND opt > 0.1)
 SELECT round(v, 6) AS median, n FROM q WHERE i = n // 2""")
def scale_median(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "frame_id")
    p = view(spark, d, "fx_frames").withColumn("n", F.lead(F.struct("cx", "cz")).over(w)).where("n IS NOT NULL")
    dx, dz = F.col("n.cx") - F.col("cx"), F.col("n.cz") - F.col("cz")
    m = ag.upper_median(ag.scale_ratios(p.select(F.sqrt(dx * dx + dz * dz).alias("device"), (F.abs(dx) + F.abs(dz)).alias("optimised"))), "ratio")
    return m.select(r(F.col("median")).alias("median"), "n")


# --- camera --------------------------------------------------------------------------------------------------------

def _pose(x: str, y: str, z: str) -> Column:
    e = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    return se3.compose(e, (F.col(x), F.col(y), F.col(z)))


def _observed(spark, d) -> DataFrame:
    o = view(spark, d, "fx_observations")
    return o.join(view(spark, d, "fx_frames").select("frame_id", "cx", "cy", "cz"), "frame_id").join(view(spark, d, "fx_landmarks").select(F.col("id").alias("landmark_id"), "x", "y", "z"), "landmark_id")


_OBS = "o AS (SELECT o.*, f.cx, f.cy, f.cz, l.x, l.y, l.z FROM fx_observations o JOIN fx_frames f ON f.frame_id = o.frame_id JOIN fx_landmarks l ON l.id = o.landmark_id)"
_PU = f"CAST((x - cx) * ({FOCAL} / -(z - cz)) + {CENTRE_X} AS FLOAT)"
_PV = f"CAST(-(y - cy) * ({FOCAL} / -(z - cz)) + {CENTRE_Y} AS FLOAT)"


def _projected(spark, d) -> DataFrame:
    o = _observed(spark, d).where("abs(z - cz) > 0.05")
    u, v = camera.project_to_image(_pose("cx", "cy", "cz"), F.lit(FOCAL), F.lit(CENTRE_X), F.lit(CENTRE_Y), F.col("x"), F.col("y"), F.col("z"))
    return o.withColumn("pu", u.cast("double")).withColumn("pv", v.cast("double")).withColumn("behind", F.col("z") - F.col("cz") >= 0)


_PROJ = f"WITH {_OBS}, p AS (SELECT *, CAST({_PU} AS DOUBLE) AS pu, CAST({_PV} AS DOUBLE) AS pv, z - cz >= 0 AS behind FROM o WHERE abs(z - cz) > 0.05), e AS (SELECT *, sqrt((pu - u) * (pu - u) + (pv - v) * (pv - v)) AS error FROM p)"


@query(_PROJ + " SELECT landmark_id, frame_id, seq, round(pu, 1) AS pu, round(pv, 1) AS pv FROM p")
def project_to_image(spark, d):
    return _projected(spark, d).select("landmark_id", "frame_id", "seq", r(F.col("pu"), 1).alias("pu"), r(F.col("pv"), 1).alias("pv"))


@query(f"WITH {_OBS} SELECT landmark_id, frame_id, seq, round(cx + (u - {CENTRE_X}) * depth / {FOCAL}, 6) AS wx, round(cy - (v - {CENTRE_Y}) * depth / {FOCAL}, 6) AS wy, round(cz - depth, 6) AS wz FROM o")
def project_to_world(spark, d):
    x, y, z = camera.project_to_world(_pose("cx", "cy", "cz"), F.lit(FOCAL), F.lit(CENTRE_X), F.lit(CENTRE_Y), F.col("u"), F.col("v"), F.col("depth"))
    return _observed(spark, d).select("landmark_id", "frame_id", "seq", r(x).alias("wx"), r(y).alias("wy"), r(z).alias("wz"))


def _errors(spark, d) -> DataFrame:
    return _projected(spark, d).withColumn("error", F.sqrt((F.col("pu") - F.col("u")) * (F.col("pu") - F.col("u")) + (F.col("pv") - F.col("v")) * (F.col("pv") - F.col("v"))))


@query(_PROJ + " SELECT round(avg(error), 3) AS mean_error, count(*) AS n FROM e WHERE NOT behind AND error < 2000")
def reprojection_error(spark, d):
    s = ag.reprojection_summary(_errors(spark, d), inlier=~F.col("behind") & (F.col("error") < 2000))
    return s.select(r(F.col("mean_error"), 3).alias("mean_error"), "n")


@query(_PROJ + " SELECT frame_id, CASE WHEN count(*) FILTER (NOT behind) = 0 THEN -1 ELSE round(sqrt(avg(error * error) FILTER (NOT behind)), 2) END AS rmse, count(*) FILTER (NOT behind) AS n FROM e GROUP BY 1")
def reprojection_rmse(spark, d):
    s = ag.rmse(_errors(spark, d), "frame_id")
    return s.select("frame_id", F.when(F.col("n") == 0, -1.0).otherwise(r(F.col("rmse"), 2)).alias("rmse"), "n")


@query(_PROJ + """, c AS (SELECT *, (error / 100) * (error / 100) AS chi2, seq = 1 AS odo FROM e WHERE NOT behind) SELECT landmark_id, frame_id, seq, CASE WHEN odo THEN chi2 > 5.991 * 2.3 ELSE chi2 > 5.991 END AS outlier,
 CAST(NOT odo AND chi2 > 5.991 AS INT) AS level FROM c""")
def outlier_marks(spark, d):
    e = _errors(spark, d).where(~F.col("behind")).withColumn("chi2", (F.col("error") / 100) * (F.col("error") / 100)).withColumn("is_odometry", F.col("seq") == 1)
    return ag.mark_outliers(e, 5.991).select("landmark_id", "frame_id", "seq", "outlier", "level")


@query(_PROJ + f""", i AS (SELECT landmark_id AS id, cx, cy, cz, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS far FROM e WHERE NOT behind AND error < 500), g AS (SELECT id, count(*) AS n, greatest(3, 0.2 * max(far)) AS m, min(cx) AS x0,
 max(cx) AS x1, min(cz) AS z0, max(cz) AS z1 FROM i GROUP BY id), b AS (SELECT l.id, coalesce(x0 - m, l.lx) AS lx, coalesce(z0 - m, l.lz) AS lz, coalesce(x1 + m, l.ux) AS ux, coalesce(z1 + m, l.uz) AS uz, coalesce(n, 0) AS sightings
 FROM fx_landmarks l LEFT JOIN g USING (id)) SELECT id, {_BOX.format('')}, sightings FROM b""")
def inlier_update(spark, d):
    inl = _errors(spark, d).where(~F.col("behind") & (F.col("error") < 500)).select(F.col("landmark_id").alias("id"), "cx", "cy", "cz")
    return _box(ag.inlier_update(view(spark, d, "fx_landmarks"), inl), "sightings")


@query("""SELECT landmark_id, frame_id, seq, CAST(octave % 256 AS INT) AS oct, CAST(octave // 256 % 256 AS INT) AS layer, CAST(octave // 65536 AS INT) AS sub, round(power(2.0, -(octave % 256)), 8) AS scale,
 round(least(greatest(4.0 / power(power(2.0, 1.0 / 3), 2 * (octave // 256 % 256)), 0.1), 100), 6) AS info FROM fx_observations""")
def octave_unpack(spark, d):
    o = view(spark, d, "fx_observations")
    octave, layer, sub, scale = camera.octave_parts(F.col("octave"))
    return o.select("landmark_id", "frame_id", "seq", octave.alias("oct"), layer.alias("layer"), sub.alias("sub"), r(scale, 8).alias("scale"), r(camera.pixel_information(layer)).alias("info"))


@query("SELECT landmark_id, frame_id, seq, feature_rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY size DESC, seq, landmark_id) AS feature_rank FROM fx_observations WHERE size >= 2.9) q WHERE feature_rank <= 3")
def top_features_by_size(spark, d):
    return matching.top_features(view(spark, d, "fx_observations"), "frame_id", index=("seq", "landmark_id"), most=3, least_size=2.9).select("landmark_id", "frame_id", "seq", F.col("feature_rank").cast("long").alias("feature_rank"))


# --- geodesy, fixes ------------------------------------------------------------------------------------------------


def _gps(spark, d) -> DataFrame:
    return asof.interpolate(view(spark, d, "fx_positions"), view(spark, d, "fx_locations"))


_GPS = """b AS (SELECT l.session_id, l.seq, l.t, l.lat, l.lon, l.alt, l.ha, p.t AS t0, p.x AS x0, p.y AS y0, p.z AS z0 FROM fx_locations l ASOF JOIN fx_positions p ON l.session_id = p.session_id AND l.t > p.t),
 n AS (SELECT l.seq, p.t AS t1, p.x AS x1, p.y AS y1, p.z AS z1 FROM fx_locations l ASOF JOIN fx_positions p ON l.session_id = p.session_id AND l.t <= p.t),
 w AS (SELECT b.*, n.*, CASE WHEN t1 = t0 THEN 0.5 ELSE CAST(t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) END AS a FROM b JOIN n ON b.seq = n.seq),
 gps AS (SELECT session_id, w.seq, t, lat, lon, alt, ha, a * (x1 - x0) + x0 AS rel_x, a * (y1 - y0) + y0 AS rel_y, a * (z1 - z0) + z0 AS rel_z FROM w)"""


@query(f"WITH {_GPS} SELECT session_id, seq, t, lat, lon, round(rel_x, 6) AS rel_x, round(rel_y, 6) AS rel_y, round(rel_z, 6) AS rel_z FROM gps")
def asof_interpolate(spark, d):
    return _gps(spark, d).select("session_id", "seq", "t", "lat", "lon", *[r(F.col(c)).alias(c) for c in ("rel_x", "rel_y", "rel_z")])


@query("""WITH f AS (SELECT session_id % 10 AS session_id, t, min(frame_id) AS frame_id, arg_min(cx, frame_id) AS cx, arg_min(cy, frame_id) AS cy, arg_min(cz, frame_id) AS cz FROM fx_frames GROUP BY 1, 2),
 b AS (SELECT l.seq, f.t AS t0, f.cx AS x0, f.cz AS z0 FROM fx_locations l ASOF JOIN f ON l.session_id = f.session_id AND l.t >= f.t), n AS (SELECT l.seq, f.t AS t1, f.cx AS x1, f.cz AS z1 FROM fx_locations l ASOF JOIN f ON l.session_id = f.session_id AND l.t <= f.t)
 SELECT l.session_id, l.seq, round(CASE WHEN t0 < t1 THEN CAST(l.t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) * (x1 - x0) + x0 ELSE coalesce(x0, x1, -1) END, 6) AS rel_x,
 round(CASE WHEN t0 < t1 THEN CAST(l.t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) * (z1 - z0) + z0 ELSE coalesce(z0, z1, -1) END, 6) AS rel_z FROM fx_locations l LEFT JOIN b ON b.seq = l.seq LEFT JOIN n ON n.seq = l.seq""")
def gps_reinterpolate(spark, d):
    f = view(spark, d, "fx_frames").withColumn("session_id", F.col("session_id") % 10)
    o = view(spark, d, "fx_locations").withColumns({c: F.lit(-1.0) for c in ("rel_x", "rel_y", "rel_z")})
    return asof.reinterpolate(o, f, width=30 * 24 * asof.HOUR_US).select("session_id", "seq", r(F.col("rel_x")).alias("rel_x"), r(F.col("rel_z")).alias("rel_z"))


_RAD = "(pi() / 180)"


def _sql_meridian(p: str) -> str:
    m = geo.M
    return f"({m[0]!r} * {p} - sin({p}) * cos({p}) * ({m[1]!r} + sin({p}) * sin({p}) * ({m[2]!r} + sin({p}) * sin({p}) * ({m[3]!r} + sin({p}) * sin({p}) * {m[4]!r}))))"


@query(f"""WITH a AS (SELECT seq, lat * {_RAD} AS p, (lon - 139) * {_RAD} AS q, 37 * {_RAD} AS p0 FROM fx_locations), m AS (SELECT *, cos(p) / sqrt(1 - {geo.E2!r} * sin(p) * sin(p)) / sin(p) AS nu FROM a)
 SELECT seq, round({geo.EQUATOR_M} * nu * sin(q * sin(p)), 4) AS east, round({geo.EQUATOR_M} * ({_sql_meridian('p')} - {_sql_meridian('p0')} + nu * (1 - cos(q * sin(p)))), 4) AS north FROM m""")
def wgs84_to_cartesian(spark, d):
    e, n = geo.to_cartesian(F.lit(37.0), F.lit(139.0), F.col("lat"), F.col("lon"))
    return view(spark, d, "fx_locations").select("seq", r(e, 4).alias("east"), r(n, 4).alias("north"))


@query("SELECT seq, round(lat, 5) AS lat, round(lon, 5) AS lon FROM fx_locations")
def wgs84_from_cartesian(spark, d):
    e, n = geo.to_cartesian(F.lit(37.0), F.lit(139.0), F.col("lat"), F.col("lon"))
    at = view(spark, d, "fx_locations").select("seq", e.alias("e"), n.alias("n")).withColumn("at", geo.from_cartesian(F.lit(37.0), F.lit(139.0), F.col("e"), F.col("n")))
    return at.select("seq", r(F.col("at.lat"), 5).alias("lat"), r(F.col("at.lon"), 5).alias("lon"))


@query(f"WITH {_GPS} SELECT " + ", ".join(f"round(sum({c} / (ha * ha)) / sum(1 / (ha * ha)), 6) AS {c}" for c in ("rel_x", "rel_y", "rel_z", "lat", "lon", "alt")) + " FROM gps")
def gps_centroids(spark, d):
    return ag.centroids(_gps(spark, d)).select(*[r(F.col(c)).alias(c) for c in ("rel_x", "rel_y", "rel_z", "lat", "lon", "alt")])


@query(f"""WITH {_GPS} SELECT round(sum((lat - 37) * 1000 / (ha * ha) * (rel_x - 50)), 3) AS c00, round(sum((lat - 37) * 1000 / (ha * ha) * (rel_z - 50)), 3) AS c02, round(sum((lon - 139) * 1000 / (ha * ha) * (rel_x - 50)), 3) AS c10,
 round(sum((lon - 139) * 1000 / (ha * ha) * (rel_z - 50)), 3) AS c12, round(sum((alt - 100) / (ha * ha) * (rel_y - 3)), 3) AS c21 FROM gps""")
def gps_cross_cov(spark, d):
    c = ag.cross_covariance(_gps(spark, d), {"lat": 37.0, "lon": 139.0, "alt": 100.0, "rel_x": 50.0, "rel_y": 3.0, "rel_z": 50.0}, (1000.0, 1000.0, 1.0))
    return c.select(*[r(F.col(n), 3).alias(n) for n in ("c00", "c02", "c10", "c12", "c21")])


@query()
def global_alignment(spark, d):
    t = alignment.align(_gps(spark, d))
    rows = [] if t is None else [(i, j, float(t[i, j])) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "row int, col int, value double")


# --- matching ------------------------------------------------------------------------------------------------------

_KNN = "knn AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS distance FROM fx_query_desc q, fx_train_desc t QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, t.vec_id) <= 8)"
_SPLIT = _KNN + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM knn), f AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS d1, max(CASE WHEN rank = 2 THEN distance END) OVER (PARTITION BY query_id) AS d2 FROM k),
 g AS (SELECT *, d1 < {m} AND d1 < {q} * d2 AS passed, min(CASE WHEN distance > {m} OR d1 < {q} * distance THEN rank END) OVER (PARTITION BY query_id) AS bad FROM f),
 s AS (SELECT * FROM g WHERE (passed AND rank = 1) OR (NOT passed AND (bad IS NULL OR rank < bad)))"""


def _knn(spark, d) -> DataFrame:
    q = view(spark, d, "fx_query_desc").withColumnRenamed("vec_id", "query_id")
    t = view(spark, d, "fx_train_desc").withColumnRenamed("vec_id", "train_id")
    return matching.k_nearest(q, t, 8, "query_id", "train_id", "embedding")


@query(f"WITH {_KNN} SELECT query_id, train_id, round(distance, 5) AS distance FROM knn")
def knn_match(spark, d):
    return _knn(spark, d).select("query_id", "train_id", r(F.col("distance"), 5).alias("distance"))


@query(f"WITH {_KNN} SELECT query_id, train_id FROM knn WHERE distance <= 1.25")
def radius_match(spark, d):
    q = view(spark, d, "fx_query_desc").withColumnRenamed("vec_id", "query_id")
    t = view(spark, d, "fx_train_desc").withColumnRenamed("vec_id", "train_id")
    return matching.k_nearest(q, t, 8, "query_id", "train_id", "embedding", radius=1.25).select("query_id", "train_id")


@query(f"WITH {_SPLIT.format(m=1.3, q=0.97)} SELECT query_id, train_id, passed FROM s")
def ratio_test(spark, d):
    return matching.split_matches(_knn(spark, d), "query_id", 1.3, 0.97).select("query_id", "train_id", "passed")


@query(f"""WITH {_SPLIT.format(m=1.3, q=0.97)}, o AS (SELECT s.*, CAST(query_id % 7 AS DOUBLE) AS size FROM s) SELECT query_id, train_id, passed, row_number() OVER (ORDER BY passed DESC, CASE WHEN passed THEN d1 / d2 END NULLS LAST,
 CASE WHEN NOT passed THEN CAST(size > 3.5 AS INT) END DESC NULLS LAST, CASE WHEN NOT passed AND size > 3.5 THEN distance END NULLS FIRST, CASE WHEN NOT passed AND size <= 3.5 THEN -size END NULLS FIRST, query_id, train_id) AS position FROM o""")
def fallback_matches(spark, d):
    s = matching.split_matches(_knn(spark, d), "query_id", 1.3, 0.97)
    sizes = view(spark, d, "fx_query_desc").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 7).cast("double").alias("size"))
    return matching.match_order(s, sizes, "query_id", "train_id").select("query_id", "train_id", "passed", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_SPLIT.format(m=1.3, q=0.97)}, m AS (SELECT query_id, train_id FROM s WHERE passed), n AS (SELECT vec_id FROM fx_query_desc WHERE vec_id NOT IN (SELECT query_id FROM m)), top AS (SELECT max(vec_id) AS v FROM fx_train_desc)
 SELECT query_id, train_id AS landmark_id, false AS created FROM m UNION ALL SELECT vec_id, v + row_number() OVER (ORDER BY vec_id), true FROM n, top""")
def match_or_create(spark, d):
    s = matching.split_matches(_knn(spark, d), "query_id", 1.3, 0.97).where("passed").select("query_id", "train_id")
    q = view(spark, d, "fx_query_desc").select(F.col("vec_id").alias("query_id"), *[F.lit(0.0).alias(c) for c in "xyz"])
    t = view(spark, d, "fx_train_desc").select(F.col("vec_id").alias("id"), *[F.lit(0.0).alias(c) for c in "xyz"])
    return matching.match_or_create(q, s, t, "query_id", "train_id")[0]


# --- map edits, navigation -----------------------------------------------------------------------------------------


@query("SELECT id, x, z FROM fx_anchors UNION ALL SELECT 24 + row_number() OVER (ORDER BY id), x + 1, z FROM fx_anchors WHERE id < 5")
def anchor_create(spark, d):
    a = view(spark, d, "fx_anchors").select("id", "x", "z")
    return mapedit.create_anchors(a, a.where("id < 5").select(F.col("id").alias("o"), (F.col("x") + 1).alias("x"), "z"), "o")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN x + 10 ELSE x END AS x, z FROM fx_anchors")
def anchor_update(spark, d):
    a = view(spark, d, "fx_anchors").select("id", "x", "z")
    return mapedit.update_anchors(a, a.where("id % 4 = 0").withColumn("x", F.col("x") + 10), ("x", "z"))


@query("SELECT src, dst FROM fx_edges WHERE src % 6 <> 0 AND dst % 6 <> 0")
def anchor_remove(spark, d):
    a = view(spark, d, "fx_anchors")
    return mapedit.remove_anchors(a, view(spark, d, "fx_edges"), a.where("id % 6 = 0"))[1]


@query("SELECT src, dst FROM fx_edges UNION ALL SELECT id, (id + 5) % 25 FROM fx_anchors UNION ALL SELECT (id + 5) % 25, id FROM fx_anchors")
def edge_add(spark, d):
    return mapedit.add_edges(view(spark, d, "fx_edges"), view(spark, d, "fx_anchors").select(F.col("id").alias("src"), ((F.col("id") + 5) % 25).alias("dst")))


@query("SELECT src, dst FROM fx_edges WHERE NOT (src % 5 = 0 AND dst = (src + 1) % 25) AND NOT (dst % 5 = 0 AND src = (dst + 1) % 25)")
def edge_remove(spark, d):
    gone = view(spark, d, "fx_anchors").where("id % 5 = 0").select(F.col("id").alias("src"), ((F.col("id") + 1) % 25).alias("dst"))
    return mapedit.remove_edges(view(spark, d, "fx_edges"), gone)


@query("SELECT id, CASE WHEN id < 3 THEN 'removed' WHEN id > 22 THEN 'updated' END AS change FROM fx_anchors WHERE id < 3 OR id > 22")
def map_changes(spark, d):
    a = view(spark, d, "fx_anchors")
    after = a.where("id >= 3").withColumn("x", F.when(F.col("id") > 22, F.col("x") + 1).otherwise(F.col("x")))
    return mapedit.changes(a, after)


@query("WITH p AS (SELECT x AS px, z AS pz FROM fx_anchors ORDER BY id LIMIT 1) SELECT id, round(px + (x - px) * 1.5, 6) AS x, round(y * 1.5, 6) AS y, round(pz + (z - pz) * 1.5, 6) AS z, round(px + (lx - px) * 1.5, 6) AS lx, round(pz + (uz - pz) * 1.5, 6) AS uz FROM fx_landmarks, p")
def map_rescale(spark, d):
    l = mapedit.rescale(view(spark, d, "fx_landmarks"), 1.5, mapedit.pivot_of(view(spark, d, "fx_anchors")), bounds=True)  # noqa: E741
    return l.select("id", *[r(F.col(c)).alias(c) for c in ("x", "y", "z", "lx", "uz")])


_ORIGIN = [[0.5, 0.0, 0.1, 3.0], [0.0, 1.0, 0.0, -2.0], [-0.1, 0.0, 0.5, 7.0], [0.0, 0.0, 0.0, 1.0]]


@query("SELECT id, round(0.5 * x + 0.1 * z + 3, 6) AS a, round(y - 2, 6) AS b, round(-0.1 * x + 0.5 * z + 7, 6) AS c, round(x, 6) AS x, round(z, 6) AS z FROM fx_landmarks")
def origin_points(spark, d):
    l = view(spark, d, "fx_landmarks").select("id", "x", "y", "z")  # noqa: E741
    a, b, c = mapedit.global_point(_ORIGIN, F.col("x"), F.col("y"), F.col("z"))
    g = l.select("id", a.alias("a"), b.alias("b"), c.alias("c"))
    x, _, z = mapedit.relative_point(_ORIGIN, F.col("a"), F.col("b"), F.col("c"))
    return g.select("id", *[r(F.col(n)).alias(n) for n in "abc"], r(x).alias("x"), r(z).alias("z"))


_COST = """WITH RECURSIVE w AS (SELECT DISTINCT e.src, e.dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS w FROM fx_edges e JOIN fx_anchors a ON a.id = e.src JOIN fx_anchors b ON b.id = e.dst),
 p AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS cost, [CAST(0 AS BIGINT)] AS seen UNION ALL SELECT w.dst, p.cost + w.w, list_append(p.seen, w.dst) FROM p JOIN w ON w.src = p.id WHERE len(p.seen) < 9 AND NOT list_contains(p.seen, w.dst)),
 c AS (SELECT id, min(cost) AS cost FROM p GROUP BY id)"""


@query(_COST + " SELECT id, round(cost, 6) AS cost FROM c")
def nav_costs(spark, d):
    return graph.shortest_costs(view(spark, d, "fx_anchors"), view(spark, d, "fx_edges"), 0).select("id", r(F.col("cost")).alias("cost"))


@query(_COST + ", q AS (SELECT p.seen FROM p JOIN c ON c.id = p.id AND p.cost = c.cost WHERE p.id = 13 ORDER BY p.cost LIMIT 1) SELECT CAST(i - 1 AS INT) AS step, seen[i] AS id FROM q, range(1, 20) t(i) WHERE i <= len(seen)")
def nav_path(spark, d):
    return graph.path(view(spark, d, "fx_anchors"), view(spark, d, "fx_edges"), 0, 13).select("step", "id")


@query(f"SELECT id FROM fx_landmarks WHERE {_TOUCH} ORDER BY sightings DESC, id LIMIT 10")
def service_landmarks(spark, d):
    return graph.get_landmarks(view(spark, d, "fx_landmarks"), *QUERY_RECT, limit=10).select("id")


# --- confidence, outliers, filters ---------------------------------------------------------------------------------


def _matched(spark, d) -> DataFrame:
    o = _observed(spark, d)
    return o.withColumn("distance", F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("z") - F.col("cz")) * (F.col("z") - F.col("cz"))))


_DIST = f"""WITH {_OBS}, m AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS distance FROM o), g AS (SELECT frame_id, count(*) AS n, count(*) FILTER (distance < 5) AS near, count(*) FILTER (distance >= 5 AND distance <= 25) AS mid,
 count(*) FILTER (distance > 25) AS far, avg(distance) AS mean, stddev_pop(distance) AS std, min(distance) AS least, max(distance) AS most FROM m GROUP BY 1)"""
_PQ = "CASE WHEN n >= 15 THEN greatest(0.2, least(0.9, near / 12.0)) ELSE least(0.9, near / 12.0) END"
_RQ = "CASE WHEN n >= 15 THEN greatest(0.3, least(0.8, (far + mid // 2) / 8.0)) ELSE least(0.8, (far + mid // 2) / 8.0) END"
_SC = f"CASE WHEN n < 4 THEN 0 ELSE (least(1.0, n / 50.0) + 0.7 * ({_PQ}) + 0.3 * ({_RQ})) / 2 END"


@query(_DIST + " SELECT frame_id, n, near, mid, far, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most FROM g")
def distance_distribution(spark, d):
    g = ag.distance_distribution(_matched(spark, d), "frame_id")
    return g.select("frame_id", "n", "near", "mid", "far", *[r(F.col(c)).alias(c) for c in ("mean", "std", "least", "most")])


@query(_DIST + f" SELECT frame_id, round({_SC}, 6) AS confidence FROM g")
def confidence_stratified(spark, d):
    g = ag.distance_distribution(_matched(spark, d), "frame_id")
    return g.select("frame_id", r(confidence.stratified_confidence(F.col("near"), F.col("mid"), F.col("far"), F.col("n"))).alias("confidence"))


@query(_DIST + f""", k AS (SELECT *, {_PQ} AS pq, {_RQ} AS rq, {_SC} AS conf FROM g), u AS (SELECT *, 0.2 / greatest(0.1, pq) * CASE WHEN n > 1 THEN 1 + std / greatest(0.1, mean) ELSE 1 END * sqrt(greatest(1.0, 20.0 / n)) / greatest(0.1, conf) AS p,
 0.1 / greatest(0.1, rq) * CASE WHEN mean > 0 THEN 1 / least(mean / 5, 3) ELSE 1 END * sqrt(greatest(1.0, 20.0 / n)) / greatest(0.1, conf) AS o FROM k)
 SELECT frame_id, round(p * p, 4) AS position, round(o * o, 4) AS orientation, round(CASE WHEN mean > 25 AND far > near THEN least(mean * 0.005, 0.1) ELSE 0 END, 6) AS crossing FROM u""")
def noise_stratified(spark, d):
    g = ag.distance_distribution(_matched(spark, d), "frame_id")
    c = confidence.stratified_confidence(F.col("near"), F.col("mid"), F.col("far"), F.col("n"))
    p, o, x = confidence.stratified_noise(*(F.col(k) for k in ("near", "mid", "far", "n", "mean", "std")), c)
    return g.select("frame_id", r(p, 4).alias("position"), r(o, 4).alias("orientation"), r(x).alias("crossing"))


_SPREAD = "s AS (SELECT frame_id, count(*) AS n, CASE WHEN count(*) < 4 THEN 0.1 ELSE least(1.0, (max(floor(u)) - min(floor(u)) + 1) * (max(floor(v)) - min(floor(v)) + 1) / 307200.0 * 2) END AS spread FROM fx_observations GROUP BY 1)"


@query(f"WITH {_SPREAD} SELECT frame_id, n, round(spread, 6) AS spread, round(least(1.0, n / 50.0), 6) AS simple, round(least(1.0, n / 50.0) * spread, 6) AS geometric FROM s")
def confidence_simple_geometric(spark, d):
    s = ag.image_spread(view(spark, d, "fx_observations"), "frame_id")
    return s.select("frame_id", "n", r(F.col("spread")).alias("spread"), r(confidence.simple_confidence(F.col("n"))).alias("simple"), r(confidence.geometric_confidence(F.col("n"), F.col("spread"))).alias("geometric"))


@query(f"""WITH {_SPREAD}, c AS (SELECT *, 1 / greatest(0.1, least(1.0, n / 50.0) * spread) AS f FROM s) SELECT frame_id, round(0.04 * f * f * greatest(1.0, 20.0 / n), 4) AS position, round(0.01 * f * f * greatest(1.0, 20.0 / n), 4) AS orientation FROM c""")
def noise_geometric(spark, d):
    s = ag.image_spread(view(spark, d, "fx_observations"), "frame_id")
    p, o = confidence.geometric_noise(confidence.geometric_confidence(F.col("n"), F.col("spread")), F.col("n"))
    return s.select("frame_id", r(p, 4).alias("position"), r(o, 4).alias("orientation"))


@query("SELECT frame_id, round(least(1.0, avg(size) / 20) * exp(-var_pop(size) / 100), 6) AS quality FROM fx_observations GROUP BY 1")
def scale_quality(spark, d):
    return ag.scale_quality(view(spark, d, "fx_observations"), "frame_id").select("frame_id", r(F.col("quality")).alias("quality"))


@query(_PROJ + """, g AS (SELECT frame_id, sqrt(avg(error * error) FILTER (NOT behind)) AS rmse, count(*) FILTER (NOT behind) AS n, count(*) AS m FROM e GROUP BY 1) SELECT frame_id, round(CASE WHEN n < 4 OR rmse IS NULL THEN 0 ELSE greatest(0.01, least(0.95,
 0.3 * exp(-0.6931471806 * rmse / 5) + 0.3 * exp(-0.6931471806 * 0.1 / 0.5) + 0.2 * exp(-0.6931471806 * 0.05 / 0.25) + 0.1 * least(1.0, n / 30.0) + 0.1 * least(1.0, 10.0 * n / m))) END, 6) AS confidence FROM g""")
def confidence_reprojection(spark, d):
    e = _errors(spark, d)
    s = ag.rmse(e, "frame_id").join(e.groupBy("frame_id").agg(F.count("*").alias("m")), "frame_id")
    return s.select("frame_id", r(confidence.reprojection_confidence(F.col("rmse"), F.lit(0.1), F.lit(0.05), F.col("n"), F.col("m"))).alias("confidence"))


@query("WITH p AS (SELECT *, z - lag(z) OVER (PARTITION BY session_id ORDER BY t, seq) AS step FROM fx_measurements) SELECT session_id, seq, abs(step) > 2 AS far, confidence < 0.3 AS unsure, step * step / 400 > 0.5 * 5.348 / greatest(0.1, confidence) AS chi2 FROM p WHERE step IS NOT NULL")
def outlier_tests(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "seq")
    p = view(spark, d, "fx_measurements").withColumn("step", F.col("z") - F.lag("z").over(w)).where("step IS NOT NULL")
    return p.select(
        "session_id", "seq", confidence.distance_outlier(F.abs("step"), F.lit(0.0)).alias("far"), confidence.confidence_outlier(F.col("confidence")).alias("unsure"), confidence.chi2_outlier(F.col("step") * F.col("step") / 400, F.col("confidence")).alias("chi2"),
    )


@query("""WITH p AS (SELECT *, confidence < 0.3 AS bad, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM fx_measurements), g AS (SELECT *, sum(CAST(NOT bad AS INT)) OVER (PARTITION BY session_id ORDER BY i) AS run FROM p)
 SELECT session_id, seq, CAST(sum(CAST(bad AS INT)) OVER (PARTITION BY session_id, run ORDER BY i) AS BIGINT) AS streak FROM g""")
def outlier_streak(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "seq")
    p = view(spark, d, "fx_measurements").withColumn("bad", confidence.confidence_outlier(F.col("confidence")).cast("int"))
    p = p.withColumn("run", F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.select("session_id", "seq", F.sum("bad").over(Window.partitionBy("session_id", "run").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)).alias("streak"))


@query("SELECT session_id, round(list_reduce(list(z ORDER BY t, seq), lambda a, b: 0.9 * a + 0.1 * b), 6) AS state FROM fx_measurements GROUP BY 1")
def ema_filter(spark, d):
    m = view(spark, d, "fx_measurements").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "z"))), lambda s: s["z"]).alias("v"))
    state = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda a, b: 0.9 * a + 0.1 * b)
    return m.select("session_id", r(state).alias("state"))


# --- encodings -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, base64(encode(c_name)) AS text, c_name AS back FROM customer")
def base64_roundtrip(spark, d):
    from terrakite.plans.stage import table

    c = table(spark, d, "customer")
    e = F.base64(F.encode("c_name", "UTF-8"))
    return c.select("c_custkey", e.alias("text"), F.decode(F.unbase64(e), "UTF-8").alias("back"))


@query("SELECT vec_id, round(CAST(embedding[2] AS DOUBLE), 6) AS m10, round(CAST(embedding[5] AS DOUBLE), 6) AS m01 FROM embeddings")
def matrix_transpose(spark, d):
    from terrakite.plans.stage import table

    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double")).alias("m"))
    t = e.withColumn("t", se3.transpose(F.col("m")))
    return t.select("vec_id", r(se3.at(F.col("t"), 0, 1)).alias("m10"), r(se3.at(F.col("t"), 1, 0)).alias("m01"))
