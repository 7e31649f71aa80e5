import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakite.functions import se3
from terrakite.functions.rects import Rect
from terrakite.operators import aggregates, alignment, asof, graph, mapedit, matching, reconstruction, spatial

REGIONS = [(1, 12, 4, 24, 15), (2, 23, 24, 26, 26), (3, 12, 22, 16, 26), (4, 2, 16, 23, 17), (5, 1, 1, 2, 4), (6, 9, 14, 13, 18), (7, 5, 19, 8, 23), (8, 20, 14, 26, 22)]


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([(i, float(a), float(b), float(c), float(d), i % 3) for i, a, b, c, d in REGIONS], "id bigint, lx double, lz double, ux double, uz double, sightings int")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_find(regions):
    q = Rect.of(1, 1, 24, 15)
    assert ids(spatial.find(regions, q)) == [1, 5, 6, 8]
    assert ids(spatial.find(regions, q, 2)) == [5, 8]
    assert ids(spatial.find(regions, q, 0)) == [] and ids(spatial.find(regions, q, 9)) == [1, 5, 6, 8]
    assert ids(graph.get_landmarks(regions, 1, 1, 24, 15)) == [] and ids(graph.get_landmarks(regions, 1, 1, 24, 15, -1)) == [1, 5, 6, 8]


def test_range_join_finds_each_pair_once(spark):
    rng = random.Random(0)
    box = lambda i: (i, *(lambda x, z, w, h: (x, z, x + w, z + h))(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, 1, 20]), rng.choice([0, 2, 30])))
    a, b = [box(i) for i in range(80)], [box(i) for i in range(80)]
    a += [(900, 1.0, None, 2.0, 2.0), (901, 3.0, 3.0, 1.0, 1.0), (902, float("nan"), 0.0, float("nan"), 1.0)]
    da = spark.createDataFrame(a, "id bigint, lx double, lz double, ux double, uz double")
    db = spark.createDataFrame(b, "k bigint, bx double, bz double, cx double, cz double")
    got = [tuple(r) for r in spatial.range_join(da, db, Rect.named(), Rect(F.col("bx"), F.col("bz"), F.col("cx"), F.col("cz")), 7.0).select("id", "k").collect()]
    want = {(p[0], q[0]) for p in a[:80] for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_range_join_tries_equal_rectangles_once(spark):
    """A crowd of equal rectangles in one cell that touch nothing: pairing them one by one takes 10**10 comparisons."""
    l = spark.range(100_000).select(F.col("id").alias("a"), *[F.lit(v).alias(c) for c, v in zip(("lx", "lz", "ux", "uz"), (0.0, 0.0, 1.0, 1.0))])  # noqa: E741
    far = F.col("id") > 2
    r = spark.range(100_000).select(F.col("id").alias("b"), *[F.when(far, v).otherwise(w).alias(c) for c, v, w in (("bx", 5.0, 1.0), ("bz", 5.0, -0.0), ("cx", 6.0, 1.0), ("cz", 6.0, 0.0))])
    join = spatial.range_join(l, r, Rect.named(), Rect(F.col("bx"), F.col("bz"), F.col("cx"), F.col("cz")), 7.0)
    assert tuple(join.agg(F.count("*"), F.countDistinct("a"), F.countDistinct("b")).first()) == (300_000, 100_000, 3)
    spatial_rows = join.where("a = 5").orderBy("b")
    assert [x.b for x in spatial_rows.collect()] == [0, 1, 2]


def test_range_join_shuffles_rows_and_no_pairs(spark):
    """100,000 squares of ten places that each touch 200 others: the 20,000,000 pairs are not shuffled."""
    box = lambda n, x: [c.alias(m) for m, c in zip(n, (x, x, x + 1, x + 1))]
    l = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("a"), *box(("lx", "lz", "ux", "uz"), F.col("id") % 10 / 100))  # noqa: E741
    r = spark.range(0, 200, 1, 4).select(F.col("id").alias("b"), *box(("bx", "bz", "cx", "cz"), F.col("id") / 1000))
    store = spark._jsc.sc().statusStore()
    written = lambda: store.executorSummary("driver").totalShuffleWrite()
    rects = Rect.named(), Rect(F.col("bx"), F.col("bz"), F.col("cx"), F.col("cz"))
    join = spatial.range_join(l, r, *rects, 4.0)
    assert join.columns == l.columns + r.columns
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual, before = spark.conf.get(key), written()
    spark.conf.set(key, "-1")  # as for tables that are large
    try:
        got = join.agg(F.count("*"), F.sum("a"), F.sum("b"), F.max("cx") - F.max("ux")).first()
    finally:
        spark.conf.set(key, usual)
    assert tuple(got) == (20_000_000, 200 * 4_999_950_000, 100_000 * 19_900, pytest.approx(0.199 - 0.09))
    assert written() - before < 10_000_000  # bytes; 254 million when pairs were
    some = spatial.range_join(l, r.where("b < 2"), *rects, 4.0, "a", "b")
    assert some.columns == ["a", "b"] and tuple(some.agg(F.count("*"), F.sum("a"), F.sum("b")).first()) == (200_000, 2 * 4_999_950_000, 100_000)


def test_edits_of_rows(regions, spark):
    new = spark.createDataFrame([(0, 1.0), (50, 2.0), (None, 3.0)], "id bigint, lx double")
    assert ids(spatial.insert(regions.select("id", "lx"), new, order="lx")) == [1, 2, 3, 4, 5, 6, 7, 8, 50, 51, 52]
    assert ids(spatial.erase(regions, new.select(F.lit(3).cast("long").alias("id")))) == [1, 2, 4, 5, 6, 7, 8]
    with pytest.raises(Exception):
        spatial.lookup(regions, "id", 99).collect()


POS = lambda t, *xyz: (1, t, *map(float, xyz))


@pytest.mark.parametrize(
    "locations,positions,want",
    [
        ([2], [POS(1, 1, 2, 3), POS(5, 10, 20, 30)], {2: 3.25}),
        ([2, 11], [POS(10, 1, 2, 3), POS(14, 10, 20, 30)], {11: 3.25}),
        ([11], [POS(0, -1, -2, -3), POS(10, 1, 2, 3), POS(14, 10, 20, 30)], {11: 3.25}),
        ([11, 13], [POS(0, -1, -2, -3), POS(10, 1, 2, 3), POS(14, 10, 20, 30)], {11: 3.25, 13: 7.75}),
        ([11], [POS(0, -1, -2, -3), POS(10, 1, 2, 3)], {}),
        ([1], [POS(1, 1, 2, 3), POS(1, 10, 20, 30)], {1: 5.5}),
        ([0], [POS(1, 1, 2, 3), POS(1, 10, 20, 30)], {}),
        ([2], [POS(1, 1, 2, 3), POS(1, 10, 20, 30)], {}),
    ],
)
@pytest.mark.parametrize("width", [3, asof.HOUR_US])
def test_interpolate(spark, locations, positions, want, width):
    p = spark.createDataFrame([(*r, i) for i, r in enumerate(positions)] + [(None, 1, 0.0, 0.0, 0.0, 99), (1, None, 0.0, 0.0, 0.0, 98)], "session_id bigint, t bigint, x double, y double, z double, seq bigint")
    loc = spark.createDataFrame([(1, t) for t in locations] + [(None, 2), (1, None)], "session_id bigint, t bigint")
    assert {r.t: r.rel_x for r in asof.interpolate(p, loc, width=width).collect()} == want


def test_interpolate_in_spans_equals_whole(spark):
    rng = random.Random(3)
    p = spark.createDataFrame([(s, rng.randint(-400, 400), rng.random(), rng.random(), rng.random(), i) for i in range(300) for s in (1, 2)], "session_id bigint, t bigint, x double, y double, z double, seq bigint")
    loc = spark.createDataFrame([(s, t) for t in range(-420, 420, 3) for s in (1, 2, 3)], "session_id bigint, t bigint")
    key = lambda df: sorted((r.session_id, r.t, r.rel_x, r.rel_z) for r in df.collect())
    assert key(asof.interpolate(p, loc, width=11)) == key(asof.interpolate(p, loc, width=10**9))


def test_reinterpolate(spark):
    f = spark.createDataFrame([(1, 10, 0.0, 0.0, 0.0, 1), (1, 20, 10.0, 0.0, 0.0, 2), (1, 20, 99.0, 0.0, 0.0, 3)], "session_id bigint, t bigint, cx double, cy double, cz double, frame_id bigint")
    o = spark.createDataFrame([(1, t, -1.0, -1.0, -1.0) for t in (5, 10, 15, 20, 25)] + [(2, 15, -1.0, -1.0, -1.0), (None, 1, -1.0, -1.0, -1.0)], "session_id bigint, t bigint, rel_x double, rel_y double, rel_z double")
    got = {(r.session_id, r.t): r.rel_x for r in asof.reinterpolate(o, f, width=7).collect()}
    assert got == {(1, 5): 0, (1, 10): 0, (1, 15): 5, (1, 20): 10, (1, 25): 10, (2, 15): -1, (None, 1): -1}


GPS = "rel_x double, rel_y double, rel_z double, lat double, lon double, alt double, ha double"


def test_centroids(spark):
    g = spark.createDataFrame([(0.0, -6.0, 4.0, 37.5236728, 139.9380725, 212.0, 10.0), (1823.9011198309, -1.0, 0.0, 37.5085404, 139.9300318, 208.0, 5.0)], GPS)
    assert list(aggregates.centroids(g).first()) == pytest.approx([1459.1208958647201, -2, 0.8, 37.51156688, 139.93163994, 208.8], abs=1e-9)


def test_alignment(spark):
    g = spark.createDataFrame([(0.0, 4.0, 0.0, 37.5236728, 139.9380725, 212.0, 10.0), (1289.6959515561, 0.0, 1289.6959515561, 37.5085404, 139.9300318, 208.0, 5.0)], GPS)
    c = aggregates.centroids(g).first().asDict()
    from terrakite.functions.geo import degree_scaling

    cc = list(aggregates.cross_covariance(g, c, tuple(map(float, degree_scaling(c["lat"], c["lon"])))).first())
    assert cc == pytest.approx([-17325.921528590075, 0, -17325.921528590075, -7333.9860039396517, 0, -7333.9860039396517, 0, 0.128, 0], rel=1e-6)
    t = alignment.align(g)
    assert t[0, 3] == pytest.approx(37.52367540433918, abs=1e-8) and t[1, 3] == pytest.approx(139.93807388383271, abs=1e-8)
    assert t[2].tolist() == pytest.approx([0, 1, 0, 208]) and t[0, 0] == pytest.approx(-3.3840531835428795e-06, abs=1e-5)
    assert alignment.align(g.limit(1)) is None and alignment.align(g.limit(0)) is None


def test_weight_of_tiny_accuracy(spark):
    w = spark.createDataFrame([(0.0,), (1e-5,), (2.0,)], "ha double").select(aggregates.weight(F.col("ha"))).collect()
    assert [r[0] for r in w] == [1e-4, 1e-4, 0.25]


def test_median_is_the_upper_one(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 50):
        v = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert aggregates.upper_median(df, "v").first()[0] == sorted(v)[n // 2]
    assert aggregates.upper_median(df.limit(0), "v").first()[0] is None
    counts = spark.createDataFrame([(float(i), 1 + i % 3) for i in range(500)], "v double, c bigint")
    flat = [float(i) for i in range(500) for _ in range(1 + i % 3)]
    assert aggregates._nth(counts, 321, most=20) == flat[321]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(2)
    q, t = rng.normal(size=(30, 5)), rng.normal(size=(70, 5))
    dq = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)] + [(99, None, 0)], "qi bigint, v array<double>, g int")
    dt = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(t)] * 2 + [(500, [1.0], 0)], "ti bigint, v array<double>, g int")
    d = np.linalg.norm(q[:, None] - t[None], axis=2)
    got = {(r.qi, r["rank"]): r.ti for r in matching.k_nearest(dq, dt, 3, "qi", "ti", "v").collect()}
    assert got == {(i, k + 1): int(np.argsort(d[i])[k]) for i in range(30) for k in range(3)}
    grouped = {(r.qi, r.ti) for r in matching.k_nearest(dq, dt, 2, "qi", "ti", "v", group="g").collect()}
    assert grouped == {(i, int(j)) for i in range(30) for j in [j for j in np.argsort(d[i]) if j % 2 == i % 2][:2]}
    near = {(r.qi, r.ti) for r in matching.k_nearest(dq, dt, 70, "qi", "ti", "v", radius=1.5).collect()}
    assert near == {(i, j) for i in range(30) for j in range(70) if d[i, j] <= 1.5}
    assert matching.k_nearest(dq.limit(0), dt, 3, "qi", "ti", "v").collect() == []


def test_paths(spark):
    a = spark.createDataFrame([(i, float(i % 4), 0.0, float(i // 4)) for i in range(12)] + [(77, 9.0, 0.0, 9.0)], "id bigint, x double, y double, z double")
    e = mapedit.add_edges(spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([(0, 1), (1, 2), (2, 6), (6, 10), (0, 4), (4, 5), (5, 5), (3, 888)], "src bigint, dst bigint"))
    walk = lambda s, g: [r.id for r in graph.path(a, e, s, g).orderBy("step").collect()]
    assert walk(0, 10) == [0, 1, 2, 6, 10] and walk(3, 3) == [3] and walk(0, 77) == [] and walk(0, 999) == [] and walk(999, 0) == []
    assert graph.get_path(a, e, 0, 5) == {"found": True, "anchors": [(0, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 1.0, 0.0, 1.0)]}


def test_map_edits(spark):
    a = spark.createDataFrame([(3, 1.0, 0.0, 1.0), (5, 3.0, 0.0, 1.0)], "id bigint, x double, y double, z double")
    assert ids(mapedit.create_anchors(a, a.select(F.col("id").alias("o"), "x", "y", "z"), "o")) == [3, 5, 6, 7]
    moved = {r.id: r.x for r in mapedit.rescale(a, 2.0, mapedit.pivot_of(a)).collect()}
    assert moved == {3: 1.0, 5: 5.0} and mapedit.rescale(a, 0.0, mapedit.pivot_of(a)) is a
    assert list(mapedit.pivot_of(a.limit(0)).first()) == [0, 0, 0]
    e = mapedit.add_edges(spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([(3, 5), (3, 5)], "src bigint, dst bigint"))
    assert e.count() == 4 and mapedit.remove_edges(e, e.limit(1)).count() == 0
    m = se3.rigid_np(se3.rotation_np([0, 1, 0]), [1, 2, 3])
    an = spark.createDataFrame([(1, 7, m.ravel(order="F").tolist(), None), (2, 8, m.ravel(order="F").tolist(), m.ravel(order="F").tolist())], "id bigint, frame_id bigint, transform array<double>, relative_transform array<double>")
    fr = spark.createDataFrame([(7, m.ravel(order="F").tolist()), (8, m.ravel(order="F").tolist())], "id bigint, extrinsics array<double>")
    t = {r.id: np.array(r.transform).reshape(4, 4, order="F") for r in mapedit.follow_frames(an, fr).collect()}
    assert t[1] == pytest.approx(m) and t[2] == pytest.approx(m @ m)


def test_landmarks_from_a_model(spark):
    points = spark.createDataFrame([(1, 5.0, 6.0, 7.0, [(1, 0), (2, 1)]), (2, 0.0, 0.0, 0.0, [(9, 0)]), (3, 1.0, 1.0, 1.0, [(2, 7)])], "point_id bigint, x double, y double, z double, track array<struct<image_id:int,point_idx:int>>")
    images = spark.createDataFrame([(1, "a"), (2, "b")], "image_id int, name string")
    kp = spark.createDataFrame([(i, n, 1.0, 2.0, 3.0, 0.0) for i in (1, 2) for n in (0, 1)], "image_id int, idx int, x float, y float, size float, angle float")
    desc = spark.createDataFrame([(2, 1, b"x" * 128)], "image_id int, idx int, desc binary")
    eye = np.eye(4).ravel(order="F").tolist()
    frames = spark.createDataFrame([(0, 10, eye), (1, 11, eye)], "id bigint, timestamp bigint, extrinsics array<double>")
    lm, obs = reconstruction.landmarks_from_model(points, images, kp, desc, frames)
    r = lm.collect()
    assert [(x.id, x.x, x.y, x.z, x.sightings, bytes(x.desc)) for x in r] == [(1, 5, -6, -7, 2, b"x" * 128)]
    assert sorted((o.landmark_id, o.frame_id, round(o.depth, 4)) for o in obs.collect()) == [(1, 0, 10.4881), (1, 1, 10.4881)]


def test_numbering_without_one_big_sort(spark):
    from terrakite.plans.stage import numbered

    rng = random.Random(5)
    v = [(rng.randint(0, 9), i) for i in range(200)]
    got = numbered(spark.createDataFrame(v, "a int, b int").repartition(7), "n", -F.col("a"), "b")
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.n)] == sorted(v, key=lambda x: (-x[0], x[1]))
    assert sorted(r.n for r in got.collect()) == list(range(1, 201))
    assert numbered(spark.createDataFrame([], "a int"), "n", "a").collect() == []


def test_window_landmarks(spark):
    from terrakite.operators.aggregates import window_landmarks

    k = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "session_id bigint, frame_id bigint, n int")
    o = spark.createDataFrame([(10, 5), (10, 6), (11, 5), (99, 5), (None, 5)], "frame_id bigint, landmark_id bigint")
    got = {r.frame_id: (r.landmarks, r.observations) for r in window_landmarks(o, k, 2).collect()}
    assert got == {10: (2, 2), 11: (2, 3), 12: (1, 1), 20: (0, 0)}
    assert window_landmarks(o.limit(0), k.limit(0), 2).collect() == []


def test_top_range_join_is_the_top_of_the_range_join(spark):
    from terrakite.operators import spatial
    from terrakite.functions.rects import Rect

    rng = np.random.default_rng(8)
    left = [(i, *map(float, rng.uniform(0, 40, 2))) for i in range(120)] + [(500, None, 1.0), (501, float("nan"), 1.0)]
    right = [(i, *(lambda x, z, h: (x - h, z - h, x + h, z + h))(*map(float, rng.uniform(0, 40, 2)), float(rng.choice([0.5, 3.0, 9.0]))), int(rng.integers(0, 5)) if i % 11 else None) for i in range(300)] + [(900, 5.0, 5.0, 1.0, 9.0, 9), (901, None, 1.0, 2.0, 2.0, 9)]
    l = spark.createDataFrame(left, "q bigint, cx double, cz double")  # noqa: E741
    r = spark.createDataFrame(right, "id bigint, lx double, lz double, ux double, uz double, sightings int")
    square = spatial.query_square(F.col("cx"), F.col("cz"), 4.0)
    want = sorted(map(tuple, spatial.top_per_query(spatial.range_join(l, r, square, Rect.named(), 5.0), "q", 3).select("q", "id", "sightings").collect()), key=str)
    old = spatial.BLOCK_LEFT, spatial.BLOCK_RIGHT
    for left_rows, right_rows in (old, (7, 9)):
        spatial.BLOCK_LEFT, spatial.BLOCK_RIGHT = left_rows, right_rows
        try:
            got = sorted(map(tuple, spatial.top_range_join(l, r, "q", "id", square, Rect.named(), 5.0, 3).collect()), key=str)
        finally:
            spatial.BLOCK_LEFT, spatial.BLOCK_RIGHT = old
        assert got == want
    assert spatial.top_range_join(l.limit(0), r, "q", "id", square, Rect.named(), 5.0, 3).collect() == []
    assert spatial.top_range_join(l, r, "q", "id", square, Rect.named(), 5.0, 0).collect() == []
