import numpy as np
import pytest

from terrakite.llm.similar_vectors import DIM, LEVELS, ascend, fit_forest, forest_nearest, k_nearest, partitionings_for, ranges, similar_vectors


def near_copies(rng, base, spread):
    return np.clip(base.astype(int) + rng.normal(0, spread, base.shape).round().astype(int), 0, 255).astype(np.uint8)


def brute(q, lm, ids, k, radius):
    d = ((q[:, None, :].astype(int) - lm[None].astype(int)) ** 2).sum(2)
    out = set()
    for i, row in enumerate(d):
        for j in sorted(np.flatnonzero(row <= radius * radius), key=lambda j: (row[j], ids[j]))[:k]:
            out.add((i, int(ids[j])))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    lm = np.minimum(255, rng.gamma(0.7, 40, (3000, DIM))).astype(np.uint8)
    q = near_copies(rng, lm[:400], 8)
    return lm, q


def test_exact_search_inside_a_node(data):
    lm, q = data
    ids = np.arange(len(lm))[::-1].copy()
    i, found, d = k_nearest(q[:50], lm, ids, 3, 600.0)
    assert {(int(a), int(b)) for a, b in zip(i, found)} == brute(q[:50], lm, ids, 3, 600.0)


def test_ranges_and_the_ascent_of_all_trees_together():
    a = np.sort(np.array([0, 1, 5, 5, 6, 300, 4**LEVELS - 1]))
    b = np.sort(np.array([0, 0, 0, 5, 9, 9, 700]))
    lo, hi = ranges(a, np.array([5, 300, 2]), LEVELS)
    assert list(hi - lo) == [2, 1, 0]
    one = ascend(np.stack([a]), np.array([[5, 300, 4**LEVELS - 1, 2]]), 2)
    assert one[0] == LEVELS and one[3] == LEVELS - 1 and one[1] < LEVELS and one[2] == 0
    # 5 has two landmarks in the first tree and one in the second: three together without ascending
    assert ascend(np.stack([a, b]), np.array([[5], [5]]), 3)[0] == LEVELS
    assert ascend(np.stack([a, b]), np.array([[5], [5]]), 4)[0] == LEVELS - 1
    assert ascend(np.stack([a]), np.array([[5]]), 100)[0] == 0


def test_queries_stop_below_the_root_with_little_loss():
    rng = np.random.default_rng(3)
    centres = rng.gamma(0.7, 40, (60, DIM))
    lm = np.clip(centres[rng.integers(0, 60, 20_000)] + rng.normal(0, 14, (20_000, DIM)), 0, 255).astype(np.uint8)
    q = near_copies(rng, lm[:300], 5)
    forest = fit_forest(lm[:5000], q, len(lm), len(q))
    strings = np.sort(forest.strings(lm), axis=1)
    depth = ascend(strings, forest.strings(q), 1024)
    assert (depth > 0).mean() > 0.9
    i, found, _ = forest_nearest(forest, q, lm, np.arange(len(lm)), 8, 150.0, 1024)
    want = brute(q, lm, np.arange(len(lm)), 8, 150.0)
    got = {(int(a), int(b)) for a, b in zip(i, found)}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("least", [4096, 16])
def test_recall_and_no_false_results(spark, data, least):
    lm, q = data
    ldf = spark.createDataFrame([(int(i), bytes(v), "x") for i, v in enumerate(lm)] + [(None, bytes(DIM), "x"), (9, None, "x"), (10, b"short", "x"), (0, bytes(lm[0]), "x")], "id bigint, vec binary, owner string")
    blobs = [(1, bytes(q[:250].tobytes())), (2, bytes(q[250:].tobytes())), (2, bytes(q[250:].tobytes())), (None, bytes(DIM)), (3, b"abc"), (4, b""), (5, None)]
    qdf = spark.createDataFrame(blobs, "owner bigint, vec binary")
    got = [tuple(r)[:3] for r in similar_vectors(qdf, ldf, min_candidates=least).collect()]
    assert len(got) == len(set(got))
    got = {(r[1] + (0 if r[0] == 1 else 250), r[2]) for r in got}
    want = brute(q, lm, np.arange(len(lm)), 8, 150.0)
    assert got <= want
    assert len(got & want) >= 0.9 * len(want)


def test_equal_vectors_go_to_the_smallest_ids(spark):
    v = bytes(range(DIM))
    lm = spark.createDataFrame([(i, v) for i in range(30, 0, -1)] * 2, "id bigint, vec binary")
    q = spark.createDataFrame([(1, v)], "owner bigint, vec binary")
    assert sorted(r.id for r in similar_vectors(q, lm).collect()) == list(range(1, 9))


def test_empty_tables(spark):
    none_q, none_l = spark.createDataFrame([], "owner bigint, vec binary"), spark.createDataFrame([], "id bigint, vec binary")
    some_q, some_l = spark.createDataFrame([(1, bytes(DIM))], "owner bigint, vec binary"), spark.createDataFrame([(1, bytes(DIM))], "id bigint, vec binary")
    assert similar_vectors(none_q, some_l).collect() == [] and similar_vectors(some_q, none_l).collect() == []
    assert [r.id for r in similar_vectors(some_q, some_l).collect()] == [1]


def test_more_partitionings_for_fewer_shared_characters():
    assert partitionings_for(0.99) == 3
    assert partitionings_for(0.68) == 3 < partitionings_for(0.5) < partitionings_for(0.2) == 12


def test_hot_branches_are_cut_into_blocks_without_loss(spark, data):
    import terrakite.llm.similar_vectors as sv

    lm, q = data
    old, sv.BLOCK_ROWS = sv.BLOCK_ROWS, 7
    try:
        ldf = spark.createDataFrame([(int(i), bytes(v)) for i, v in enumerate(lm[:600])], "id bigint, vec binary")
        qdf = spark.createDataFrame([(1, q[:100].tobytes())], "owner bigint, vec binary")
        cut = {tuple(r) for r in sv.similar_vectors(qdf, ldf).collect()}
    finally:
        sv.BLOCK_ROWS = old
    whole = {tuple(r) for r in sv.similar_vectors(qdf, ldf).collect()}
    assert cut <= whole and len(cut) >= 0.9 * len(whole)


def test_a_crowd_of_equal_queries_and_landmarks_is_split(spark, data):
    import terrakite.llm.similar_vectors as sv

    lm, _ = data
    v = lm[0].tobytes()
    forest = fit_forest(np.repeat(lm[:1], 900, 0), np.repeat(lm[:1], 900, 0), 900_000, 900_000)
    assert forest.landmark_blocks.max() == 9 and forest.query_blocks.max() == 5
    ldf = spark.createDataFrame([(i, v) for i in range(50)], "id bigint, vec binary")
    qdf = spark.createDataFrame([(i, v) for i in range(60)], "owner bigint, vec binary")
    old, sv.BLOCK_ROWS = sv.BLOCK_ROWS, 5
    try:
        got = [tuple(r)[:3] for r in sv.similar_vectors(qdf, ldf).collect()]
    finally:
        sv.BLOCK_ROWS = old
    assert sorted(got) == [(i, 0, j) for i in range(60) for j in range(8)]


def test_a_branch_is_cut_only_where_one_task_cannot_hold_it(data):
    import terrakite.llm.similar_vectors as sv

    lm, q = data
    crowd = np.tile(lm, (4, 1))
    rows = 128 * 3 * sv.BLOCK_ROWS  # three blocks a branch: one task holds them
    large = fit_forest(crowd, q, rows, rows)
    assert not large.cut.any() and large.landmark_blocks.max() == large.query_blocks.max() == 1
    # where branches are cut, neighbours part more often, though a sample of few neighbours does not show it
    huge = fit_forest(crowd[:900], q[:1], 20 * rows, 20 * rows)
    assert huge.cut.any() and huge.partitionings > large.partitionings >= sv.LEAST_PARTITIONINGS


def test_recall_does_not_fall_with_the_rows_a_task_holds(spark, data):
    import terrakite.llm.similar_vectors as sv

    lm, q = data
    old, sv.BLOCK_ROWS = sv.BLOCK_ROWS, 10  # as for tables of thousands of times their rows
    try:
        ldf = spark.createDataFrame([(int(i), bytes(v)) for i, v in enumerate(lm)], "id bigint, vec binary")
        found = {(r.row_no, r.id) for r in sv.similar_vectors(spark.createDataFrame([(1, q.tobytes())], "owner bigint, vec binary"), ldf).collect()}
    finally:
        sv.BLOCK_ROWS = old
    want = brute(q, lm, np.arange(len(lm)), 8, 150.0)
    assert found <= want and len(found) >= 0.97 * len(want)
