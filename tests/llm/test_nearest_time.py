import random

from terrakite.llm.nearest_time import nearest_in_time

SCHEMA = "key bigint, entity bigint, t bigint, span string, probe string"


def brute(left, right, tol):
    out = {}
    for k, e, t in left:
        if None in (k, e, t):
            continue
        c = [(abs(t - rt), rt, rk) for rk, re_, rt in right if None not in (rk, re_, rt) and re_ == e and abs(t - rt) <= tol]
        if c:
            out[k] = (min(c)[2], min(c)[0])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randint(-500, 500), None])) for i in range(200)]
    right = [(1000 + i, rng.choice([1, 1, 2, 3]), rng.randint(-500, 500)) for i in range(150)]
    right += right[:10]  # copies
    left += left[:10]
    got = {r.left_key: (r.right_key, r.apart) for r in nearest_in_time(frame(spark, left), frame(spark, right), 5, span_tolerances=2, group_rows=20).collect()}
    assert got == brute(left, right, 5)


def test_ties_go_to_the_earlier_then_smaller(spark):
    left = frame(spark, [(1, 1, 100), (2, 2, 100)])
    right = frame(spark, [(11, 1, 105), (12, 1, 95), (22, 2, 95), (21, 2, 95)])
    got = {r.left_key: r.right_key for r in nearest_in_time(left, right, 10).collect()}
    assert got == {1: 12, 2: 21}


def test_edges_of_the_tolerance_and_of_bigint(spark):
    big = 2**63 - 1
    left = frame(spark, [(1, 1, 0), (2, 1, big), (3, 1, -big)])
    right = frame(spark, [(11, 1, 10), (12, 1, -11), (13, 1, big - 10), (14, 1, -big + 11)])
    got = {r.left_key: r.right_key for r in nearest_in_time(left, right, 10).collect()}
    assert got == {1: 11, 2: 13}


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, 1, 1)])
    for a, b in ((none, some), (some, none), (none, none)):
        assert nearest_in_time(a, b, 10).collect() == []
