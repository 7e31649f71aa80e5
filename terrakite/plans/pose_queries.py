"""Queries of rigid transforms and projections with turned cameras, and of the files the sources write and read, with the SQL that checks them.

Every frame is turned about the vertical axis by an angle of its own, so that no rotation is the identity.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakite.functions import camera, se3
from terrakite.operators import aggregates as ag
from terrakite.plans.map_queries import QUERIES, SQL, query, r
from terrakite.plans.stage import _shared_dir, _written, table
from terrakite.plans.views import CENTRE_X, CENTRE_Y, FOCAL, view
from terrakite.sources import graph_text, session, sfm_sqlite, sfm_text

__all__ = ["QUERIES", "SQL"]

_ANGLE = "CAST(frame_id * 37 % 600 AS DOUBLE) / 100 - 3"
_P = f"p AS (SELECT frame_id, session_id, t, cx, cy, cz, {_ANGLE} AS a, cos({_ANGLE}) AS c, sin({_ANGLE}) AS s FROM fx_frames)"


def _turned(spark, d) -> DataFrame:
    """(frame_id, session_id, t, cx, cy, cz, a, pose)."""
    f = view(spark, d, "fx_frames").withColumn("a", F.expr(_ANGLE))
    c, s, zero, one = F.cos("a"), F.sin("a"), F.lit(0.0), F.lit(1.0)
    return f.withColumn("pose", se3.compose([[c, zero, s], [zero, one, zero], [-s, zero, c]], (F.col("cx"), F.col("cy"), F.col("cz")))).select("frame_id", "session_id", "t", "cx", "cy", "cz", "a", "pose")


def _cells(m, *at: tuple[str, int, int]) -> list:
    return [r(se3.at(m, i, j)).alias(n) for n, i, j in at]


_ALL = [(f"m{i}{j}", i, j) for i in range(3) for j in range(4)]
_RIGID = "round({0}, 6) AS m00, 0.0::DOUBLE AS m01, round({1}, 6) AS m02, round({2}, 6) AS m03, 0.0::DOUBLE AS m10, {6}::DOUBLE AS m11, 0.0::DOUBLE AS m12, round({3}, 6) AS m13, round({4}, 6) AS m20, 0.0::DOUBLE AS m21, round({5}, 6) AS m22, round({7}, 6) AS m23"


@query(f"WITH {_P} SELECT frame_id, " + _RIGID.format("c", "-s", "-(c * cx - s * cz)", "-cy", "s", "c", "1.0", "-(s * cx + c * cz)") + " FROM p")
def pose_inverse(spark, d):
    p = _turned(spark, d)
    return p.select("frame_id", *_cells(se3.invert_rigid(F.col("pose")), *_ALL))


@query(f"WITH {_P} SELECT frame_id, " + _RIGID.format("c", "s", "c * 1 + s * 3 + cx", "2 + cy", "-s", "c", "1.0", "-s * 1 + c * 3 + cz") + " FROM p")
def pose_product(spark, d):
    one = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    return _turned(spark, d).select("frame_id", *_cells(se3.multiply(F.col("pose"), se3.compose(one, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))), *_ALL))


@query(f"WITH {_P} SELECT frame_id, round(c * 4 + s * 6 + cx, 6) AS x, round(5 + cy, 6) AS y, round(-s * 4 + c * 6 + cz, 6) AS z FROM p")
def pose_apply(spark, d):
    x, y, z = se3.apply_point(F.col("pose"), F.lit(4.0), F.lit(5.0), F.lit(6.0))
    return _turned(spark, d).select("frame_id", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"))


@query(f"""WITH {_P}, q AS (SELECT *, lead(a) OVER w AS b, lead(cx) OVER w AS x, lead(cy) OVER w AS y, lead(cz) OVER w AS z FROM p WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)), n AS (SELECT *, cos(b - a) AS dc, sin(b - a) AS ds FROM q WHERE b IS NOT NULL)
 SELECT frame_id, round(dc, 6) AS m00, round(ds, 6) AS m02, round(x - (dc * cx + ds * cz), 6) AS m03, round(y - cy, 6) AS m13, round(-ds, 6) AS m20, round(dc, 6) AS m22, round(z - (-ds * cx + dc * cz), 6) AS m23 FROM n""")
def pose_relative(spark, d):
    p = _turned(spark, d)
    both = p.withColumn("other", F.lead("pose").over(Window.partitionBy("session_id").orderBy("frame_id"))).where("other IS NOT NULL")
    m = se3.relative_pose(F.col("pose"), F.col("other"))
    return both.select("frame_id", *_cells(m, *[("m%d%d" % ij, *ij) for ij in ((0, 0), (0, 2), (0, 3), (1, 3), (2, 0), (2, 2), (2, 3))]))


@query(f"WITH {_P} SELECT frame_id, round(cos(a / 2), 6) AS w, 0.0::DOUBLE AS x, round(sin(a / 2), 6) AS y, 0.0::DOUBLE AS z, round(c, 6) AS back00, round(s, 6) AS back02 FROM p")
def quaternions(spark, d):
    p = _turned(spark, d).withColumn("q", F.array(*se3.quaternion_from_rotation(se3.rotation(F.col("pose")))))
    q = [F.get("q", F.lit(i)) for i in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    back = se3.rotation_from_quaternion(*q)
    return p.select("frame_id", *[(r(v * sign) + 0.0).alias(n) for v, n in zip(q, "wxyz")], r(back[0][0]).alias("back00"), r(back[0][2]).alias("back02"))


@query(f"WITH {_P} SELECT frame_id, round(c, 6) AS m00, round(s, 6) AS m02, round(-s, 6) AS m20, 1.0::DOUBLE AS m11 FROM p")
def axis_angles(spark, d):
    m = se3.rotation_from_axis_angle(F.lit(0.0), F.col("a"), F.lit(0.0))
    return _turned(spark, d).select("frame_id", r(m[0][0]).alias("m00"), r(m[0][2]).alias("m02"), r(m[2][0]).alias("m20"), r(m[1][1]).alias("m11"))


@query(f"WITH {_P} SELECT frame_id, " + _RIGID.format("c", "-s", "-(c * cx - s * cz)", "cy", "-s", "-c", "-1.0", "s * cx + c * cz") + ", round(cx, 6) AS back_x, round(cz, 6) AS back_z, round(s, 6) AS back02 FROM p")
def camera_flip(spark, d):
    m = _turned(spark, d).withColumn("m", se3.flip_camera(F.col("pose"))).withColumn("back", se3.unflip_camera(F.col("m")))
    return m.select("frame_id", *[(c + 0.0).alias(n) for c, (n, _, _) in zip((r(se3.at(F.col("m"), i, j)) for _, i, j in _ALL), _ALL)], *_cells(F.col("back"), ("back_x", 0, 3), ("back_z", 2, 3), ("back02", 0, 2)))


@query(f"WITH {_P} SELECT frame_id, frame_id % 3 <> 0 AS valid, frame_id % 3 <> 0 AS same FROM p")
def transform_checks(spark, d):
    odd = F.col("frame_id") % 3 == 0
    p = _turned(spark, d).withColumn("m", F.transform("pose", lambda v: F.when(odd, v * 1.01).otherwise(v)))
    return p.select("frame_id", se3.valid_transform(F.col("m")).alias("valid"), se3.nearly_equal(F.col("m"), F.col("pose")).alias("same"))


@query(f"WITH {_P}, q AS (SELECT frame_id, -(c * cx - s * cz) AS x, -cy AS y, -(s * cx + c * cz) AS z, c, s FROM p) SELECT frame_id, round(x, 6) AS x, round(-y, 6) AS y, round(-z, 6) AS z, round(c, 6) AS m00, round(s, 6) AS m02, round(-s, 6) AS m20, round(c, 6) AS m22 FROM q")
def model_pose(spark, d):
    zero = F.lit(0.0)
    m = se3.sfm_pose(F.cos(F.col("a") / 2), zero, F.sin(F.col("a") / 2), zero, F.col("cx"), F.col("cy"), F.col("cz"))
    return _turned(spark, d).select("frame_id", *_cells(m, ("x", 0, 3), ("y", 1, 3), ("z", 2, 3), ("m00", 0, 0), ("m02", 0, 2), ("m20", 2, 0), ("m22", 2, 2)))


_SEEN = "o AS (SELECT o.landmark_id, o.frame_id, o.seq, o.u, o.v, o.depth, p.*, l.x, l.y, l.z FROM fx_observations o JOIN p ON p.frame_id = o.frame_id JOIN fx_landmarks l ON l.id = o.landmark_id)"


def _seen(spark, d) -> DataFrame:
    o = view(spark, d, "fx_observations").select("landmark_id", "frame_id", "seq", "u", "v", "depth")
    return o.join(_turned(spark, d), "frame_id").join(view(spark, d, "fx_landmarks").select(F.col("id").alias("landmark_id"), "x", "y", "z"), "landmark_id")


_K = f"e AS (SELECT landmark_id, o.frame_id, seq, c * (x - cx) - s * (z - cz) AS qx, y - cy AS qy, s * (x - cx) + c * (z - cz) AS qz, u, v FROM o), k AS (SELECT *, {FOCAL} / -qz AS f FROM e WHERE abs(qz) > 1)"


@query(f"WITH {_P}, {_SEEN}, {_K} SELECT landmark_id, frame_id, seq, round(qx * f + {CENTRE_X}, 0) AS pu, round(-qy * f + {CENTRE_Y}, 0) AS pv FROM k WHERE abs(qx * f + {CENTRE_X} - floor(qx * f + {CENTRE_X}) - 0.5) > 0.01 AND abs(-qy * f + {CENTRE_Y} - floor(-qy * f + {CENTRE_Y}) - 0.5) > 0.01")
def project_to_image_turned(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    q = camera.camera_point(F.col("pose"), x, y, z)
    u, v = camera.project_to_image(F.col("pose"), F.lit(FOCAL), F.lit(CENTRE_X), F.lit(CENTRE_Y), x, y, z)
    o = _seen(spark, d).where(F.abs(q[2]) > 1)
    f = FOCAL / -q[2]
    clear = lambda e: F.abs(e - F.floor(e) - 0.5) > 0.01  # noqa: E731  single precision must not decide a rounding
    o = o.where(clear(q[0] * f + CENTRE_X) & clear(-q[1] * f + CENTRE_Y))
    return o.select("landmark_id", "frame_id", "seq", r(u, 0).alias("pu"), r(v, 0).alias("pv"))


@query(f"""WITH {_P}, {_SEEN}, q AS (SELECT landmark_id, o.frame_id, seq, (u - {CENTRE_X}) * depth / {FOCAL} AS qx, -(v - {CENTRE_Y}) * depth / {FOCAL} AS qy, -depth AS qz, c, s, cx, cy, cz FROM o)
 SELECT landmark_id, frame_id, seq, round(c * qx + s * qz + cx, 6) AS wx, round(qy + cy, 6) AS wy, round(-s * qx + c * qz + cz, 6) AS wz FROM q""")
def project_to_world_turned(spark, d):
    x, y, z = camera.project_to_world(F.col("pose"), F.lit(FOCAL), F.lit(CENTRE_X), F.lit(CENTRE_Y), F.col("u"), F.col("v"), F.col("depth"))
    return _seen(spark, d).select("landmark_id", "frame_id", "seq", r(x).alias("wx"), r(y).alias("wy"), r(z).alias("wz"))


@query("SELECT vec_id, i, j, round(CAST(embedding[1 + i * 4 + j] AS DOUBLE), 6) AS value FROM embeddings, range(4) a(i), range(4) b(j)")
def matrix_transpose_whole(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double")).alias("m"))
    t = e.select("vec_id", se3.transpose(F.col("m")).alias("t"))
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), r(F.get("t", F.lit(j * 4 + i))).alias("value")) for i in range(4) for j in range(4)])
    return t.select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


@query("SELECT id, x, z, sightings FROM fx_landmarks WHERE sightings >= 3")
def cull(spark, d):
    return ag.cull(view(spark, d, "fx_landmarks")).select("id", "x", "z", "sightings")


@query("SELECT count(*) AS frames, round(100.0 * count(*) FILTER (frame_id % 4 <> 0) / count(*), 6) AS success_percent, round(1000.0 * sum(cx / 1000 + 0.001) / count(*), 6) AS ms_per_frame, round(count(*) / sum(cx / 1000 + 0.001), 6) AS fps FROM fx_frames")
def localization_kpis(spark, d):
    f = view(spark, d, "fx_frames").select((F.col("frame_id") % 4 != 0).alias("success"), (F.col("cx") / 1000 + 0.001).alias("seconds"))
    k = ag.localization_kpis(f)
    return k.select("frames", *[r(F.col(c)).alias(c) for c in ("success_percent", "ms_per_frame", "fps")])


@query("SELECT landmark_id, frame_id, seq, round(u * power(2.0, octave % 256), 6) AS full_u, round(u * power(2.0, -(octave % 256)), 6) AS octave_u FROM fx_observations")
def octave_scales(spark, d):
    o = view(spark, d, "fx_observations")
    octave = camera.octave_parts(F.col("octave"))[0]
    return o.select("landmark_id", "frame_id", "seq", r(camera.full_resolution(F.col("u"), octave)).alias("full_u"), r(camera.octave_space(F.col("u"), octave)).alias("octave_u"))


@query(f"""WITH {_P}, {_SEEN}, h AS (SELECT landmark_id AS id, t, frame_id, seq, u, v, cx, cz, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS h FROM (SELECT o.landmark_id, o.t, o.seq, o.u, o.v, o.cx, o.cz, o.x, o.z, o.frame_id FROM o) w)
 SELECT id, round(min(cx - h), 6) AS lx, round(max(cz + h), 6) AS uz, count(*) AS sightings, arg_max(u, t * 1000000000 + frame_id * 10 + seq) AS normal_x, arg_max(v, t * 1000000000 + frame_id * 10 + seq) AS normal_y FROM h GROUP BY 1""".replace("t * 1000000000", "CAST(t AS HUGEINT) * 1000000000"))
def landmark_orientation_latest(spark, d):
    o = _seen(spark, d).select(F.col("landmark_id").alias("id"), "t", "cx", "cz", F.array("u", "v", F.lit(0.0)).alias("orientation"), F.struct("t", "frame_id", "seq").alias("order"))
    b = ag.recorded_observations(view(spark, d, "fx_landmarks"), o, order="order")
    return b.select("id", r(F.col("lx")).alias("lx"), r(F.col("uz")).alias("uz"), "sightings", F.get("orientation", F.lit(0)).alias("normal_x"), F.get("orientation", F.lit(1)).alias("normal_y"))


@query(f"""WITH {_P}, {_SEEN}, g AS (SELECT landmark_id AS id, greatest(3, 0.2 * max(sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)))) AS m, min(cx) AS x0, max(cx) AS x1, min(cz) AS z0, max(cz) AS z1 FROM o GROUP BY 1)
 SELECT id, round(x0 - m, 6) AS lx, round(z0 - m, 6) AS lz, round(x1 + m, 6) AS ux, round(z1 + m, 6) AS uz FROM g""")
def landmark_bounds_stored(spark, d):
    x, y, z = se3.position(F.col("pose"))
    seen = _seen(spark, d).select(F.col("landmark_id").alias("id"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
    l = view(spark, d, "fx_landmarks").join(seen.select("id").distinct(), "id", "left_semi")  # noqa: E741
    return ag.camera_bounds(l, seen).select("id", *[r(F.col(c)).alias(c) for c in ("lx", "lz", "ux", "uz")])


@query("""WITH k AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM fx_frames), w AS (SELECT k.session_id, k.n, o.landmark_id FROM k JOIN fx_observations o ON o.frame_id = k.frame_id)
 SELECT k.session_id, k.frame_id, count(DISTINCT w.landmark_id) AS landmarks, count(w.landmark_id) AS observations FROM k LEFT JOIN w ON w.session_id = k.session_id AND w.n > k.n - 10 AND w.n <= k.n GROUP BY 1, 2""")
def window_landmarks(spark, d):
    k = view(spark, d, "fx_frames").withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "frame_id")))
    return ag.window_landmarks(view(spark, d, "fx_observations"), k, 10)


@query("""WITH p AS (SELECT frame_id, lead(frame_id) OVER (ORDER BY frame_id) AS n FROM fx_frames) SELECT (frame_id + 1) * 2147483647 + n + 1 AS pair_id, frame_id + 1 AS first, n + 1 AS second FROM p WHERE n IS NOT NULL AND (frame_id + 1) % 5 <> 0""")
def missing_pairs(spark, d):
    f = _turned(spark, d).select(F.col("frame_id").alias("id"), F.col("pose").alias("extrinsics"))
    every = sfm_sqlite.missing_pairs(f, spark.createDataFrame([], "pair_id bigint"))
    stored = every.where("first % 5 = 0").select("pair_id")
    return sfm_sqlite.missing_pairs(f, stored).select("pair_id", "first", "second")


@query("SELECT CAST(frame_id + 1 AS INT) AS image_id, lpad(CAST(frame_id AS VARCHAR), greatest(8, CAST(length(CAST(frame_id AS VARCHAR)) AS INT)), '0') || '_image.jpeg' AS name FROM fx_frames")
def model_database(spark, d):
    path = "/" + _folder(spark, ".db").removeprefix("file:").lstrip("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    f = _turned(spark, d).select(F.col("frame_id").alias("id"), F.array(*[F.lit(float(i)) for i in range(9)]).alias("intrinsics"), F.col("pose").alias("extrinsics"))
    sfm_sqlite.create_database(f, path)
    return sfm_sqlite.read_database(spark, path)[0].select("image_id", "name")


# --- files -----------------------------------------------------------------------------------------------------------


def _folder(spark, end: str = "") -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{_shared_dir(spark)}/terrakite-files-{uuid.uuid4().hex}{end}"
    _written.append((spark, path))
    return path


def _session(spark, d) -> session.Session:
    desc = F.encode(F.lpad(F.col("id").cast("string"), 128, "0"), "UTF-8")
    lm = view(spark, d, "fx_landmarks").withColumns({"desc": desc, "orientation": F.array(*[F.lit(v).cast("float") for v in (0.0, 0.0, 1.0)]), "last_seen": F.lit(-1).cast("long")})
    f = _turned(spark, d).select(F.col("frame_id").alias("id"), F.col("t").alias("timestamp"), F.array(*[F.lit(float(i)) for i in range(9)]).alias("intrinsics"), F.col("pose").alias("extrinsics"))
    g = view(spark, d, "fx_locations").select(F.col("t").alias("timestamp"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("relative"), F.array("lat", "lon", "alt").alias("global"), F.array("ha", "ha", F.lit(-1.0)).alias("accuracy"))
    one = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    pose = se3.compose(one, (F.col("x"), F.col("y"), F.col("z")))
    a = view(spark, d, "fx_anchors").select("id", "frame_id", pose.alias("transform"), F.when(F.col("id") % 2 == 0, pose).alias("relative_transform"))
    meta = spark.range(1).select(F.lit(True).alias("origin_ready"), F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)]).alias("origin"))
    return session.Session(f, g, lm, a, view(spark, d, "fx_edges").distinct(), meta)


def _reread(spark, d) -> session.Session:
    folder = _folder(spark)
    session.write_session(_session(spark, d), folder)
    return session.read_session(spark, folder)


@query("SELECT id, x, y, z, sightings, lx, lz, ux, uz, lpad(CAST(id AS VARCHAR), 128, '0') AS descriptor FROM fx_landmarks")
def session_landmarks(spark, d):
    l = _reread(spark, d).landmarks  # noqa: E741
    return l.select("id", "x", "y", "z", F.col("sightings").cast("long").alias("sightings"), "lx", "lz", "ux", "uz", F.decode("desc", "UTF-8").alias("descriptor"))


@query(f"WITH {_P} SELECT frame_id AS id, t AS timestamp, round(cx, 6) AS x, round(cz, 6) AS z, round(s, 6) AS m02, 9 AS n FROM p")
def session_frames(spark, d):
    f = _reread(spark, d).frames
    return f.select("id", "timestamp", *_cells(F.col("extrinsics"), ("x", 0, 3), ("z", 2, 3), ("m02", 0, 2)), F.size("intrinsics").cast("int").alias("n"))


@query("SELECT t AS timestamp, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 6) AS alt, ha, -1.0::DOUBLE AS va FROM fx_locations")
def session_fixes(spark, d):
    g = _reread(spark, d).gps
    return g.select("timestamp", *[r(F.get("global", F.lit(i))).alias(n) for i, n in enumerate(("lat", "lon", "alt"))], F.get("accuracy", F.lit(0)).alias("ha"), F.get("accuracy", F.lit(2)).alias("va"))


@query("SELECT id, frame_id, x, z, id % 2 = 0 AS relative FROM fx_anchors")
def session_anchors(spark, d):
    a = _reread(spark, d).anchors
    return a.select("id", "frame_id", se3.at(F.col("transform"), 0, 3).alias("x"), se3.at(F.col("transform"), 2, 3).alias("z"), F.col("relative_transform").isNotNull().alias("relative"))


@query("SELECT DISTINCT src, dst FROM fx_edges")
def session_edges(spark, d):
    return _reread(spark, d).edges


@query("SELECT id, x, y, z, 1 AS frames FROM fx_landmarks")
def tables_roundtrip(spark, d):
    folder = _folder(spark)
    session.write_tables(_session(spark, d), folder)
    s = session.read_tables(spark, folder)
    return s.landmarks.select("id", "x", "y", "z", F.lit(1).alias("frames"))


@query("SELECT frame_id AS id, t AS timestamp FROM fx_frames UNION ALL SELECT count(*), 7 FROM fx_frames")
def frame_add(spark, d):
    return session.add_frame(_session(spark, d).frames, 7, [1.0] * 9, [1.0 if i % 5 == 0 else 0.0 for i in range(16)]).select("id", "timestamp")


@query("SELECT frame_id, lpad(CAST(frame_id AS VARCHAR), 8, '0') || '_' AS prefix FROM fx_frames WHERE frame_id < 100000000")
def file_prefixes(spark, d):
    f = view(spark, d, "fx_frames").where("frame_id < 100000000")
    return f.select("frame_id", session.file_prefix(F.col("frame_id")).alias("prefix"))


@query("""SELECT 'VERTEX_TRACKXYZ' AS tag, id AS first, -1 AS second, round(x, 6) AS value FROM fx_landmarks UNION ALL SELECT 'VERTEX_SE3:EXPMAP', frame_id, -1, round(cx, 6) FROM fx_frames
 UNION ALL SELECT 'FIX', frame_id, -1, 0 FROM fx_frames WHERE frame_id % 1000 = 1 UNION ALL SELECT 'EDGE_SE3:EXPMAP', frame_id, frame_id + 1, round(cz, 6) FROM fx_frames
 UNION ALL SELECT 'EDGE_PROJECT_XYZ2UVD:EXPMAP', landmark_id, frame_id, u FROM fx_observations UNION ALL SELECT 'PARAMS_CAMERAPARAMETERS', 1, -1, 1500.5""")
def graph_roundtrip(spark, d):
    f, l, o = (view(spark, d, n) for n in ("fx_frames", "fx_landmarks", "fx_observations"))  # noqa: E741
    lines = graph_text.graph_lines(
        spark.range(1).select(F.lit(1).cast("long").alias("id"), F.array(*[F.lit(v) for v in (1500.5, 960.0, 720.0, 0.0)]).alias("values")),
        f.select(F.col("frame_id").alias("id"), F.array("cx", "cy", "cz", *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("values"), (F.col("frame_id") % 1000 == 1).alias("fixed")),
        l.select("id", F.array("x", "y", "z").alias("values")),
        f.select(F.col("frame_id").alias("a"), (F.col("frame_id") + 1).alias("b"), F.array("cz", *[F.lit(0.0)] * 27).alias("values")),
        o.select(F.col("landmark_id").alias("point"), F.col("frame_id").alias("pose"), F.lit(1).alias("camera"), F.array("u", "v", "depth", *[F.lit(1.0)] * 6).alias("values")),
    )
    folder = _folder(spark)
    graph_text.write_graph(lines, folder)
    g = graph_text.read_graph(spark, folder)
    second = F.when(F.col("tag").startswith("EDGE"), F.get("ids", F.lit(1))).otherwise(-1)
    return g.select("tag", F.get("ids", F.lit(0)).alias("first"), second.cast("long").alias("second"), F.coalesce(r(F.get("values", F.lit(0))), F.lit(0.0)).alias("value"))


@query("SELECT l.id AS point_id, l.x, o.frame_id AS image_id, o.seq AS point_idx FROM fx_landmarks l JOIN fx_observations o ON o.landmark_id = l.id")
def model_points(spark, d):
    track = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "seq"))), lambda t: F.concat_ws(" ", t["frame_id"].cast("string"), t["seq"].cast("string"))), " ")
    t = view(spark, d, "fx_observations").groupBy(F.col("landmark_id").alias("id")).agg(track.alias("track"))
    lines = view(spark, d, "fx_landmarks").join(t, "id").select(F.concat_ws(" ", F.col("id").cast("string"), *[F.col(c).cast("string") for c in "xyz"], F.lit("1 2 3 0.5"), "track").alias("value"))
    folder = _folder(spark)
    lines.unionAll(spark.createDataFrame([("# a comment",), ("",), ("7 broken",)], "value string")).write.text(folder)
    p = sfm_text.read_points3d(spark, folder)
    return p.select("point_id", "x", F.explode("track").alias("t")).select("point_id", "x", F.col("t.image_id").cast("long").alias("image_id"), F.col("t.point_idx").cast("int").alias("point_idx"))


@query(f"WITH {_P} SELECT lpad(CAST(frame_id AS VARCHAR), 8, '0') || '_image.jpeg' AS name, round(cx, 6) AS x, round(-cy, 6) AS y, round(-cz, 6) AS z FROM p WHERE frame_id < 100000000")
def reference_positions(spark, d):
    f = _turned(spark, d).where("frame_id < 100000000").select(F.col("frame_id").alias("id"), F.col("pose").alias("extrinsics"))
    p = F.split("value", " ")
    return sfm_text.reference_lines(f).select(F.get(p, F.lit(0)).alias("name"), *[(r(F.get(p, F.lit(i + 1)).cast("double")) + 0.0).alias(n) for i, n in enumerate("xyz")])


@query("SELECT frame_id AS image_id, count(*) + 1 AS lines, count(*) || ' 128' AS head FROM (SELECT DISTINCT frame_id, seq FROM fx_observations) o GROUP BY 1")
def feature_files(spark, d):
    desc = F.encode(F.lpad(F.col("seq").cast("string"), 128, "0"), "UTF-8")
    o = view(spark, d, "fx_observations").dropDuplicates(["frame_id", "seq"]).select(F.col("frame_id").alias("image_id"), F.col("seq").alias("idx"), F.col("u").alias("x"), F.col("v").alias("y"), F.lit(1.0).alias("scale"), F.lit(0.5).alias("orientation"), desc.alias("desc"))
    return sfm_text.feature_lines(o).select("image_id", F.size("lines").cast("long").alias("lines"), F.get("lines", F.lit(0)).alias("head"))


@query("SELECT frame_id, round(sqrt(abs(cx * cz + 1)), 6) AS scale, round(degrees(atan2(1.0, cx)), 6) AS orientation FROM fx_frames")
def affine_shapes(spark, d):
    s, o = sfm_text.affine_to_scale(F.col("cx"), F.lit(-1.0), F.lit(1.0), F.col("cz"))
    return view(spark, d, "fx_frames").select("frame_id", r(s).alias("scale"), r(o).alias("orientation"))
