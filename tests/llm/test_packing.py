import math
import random
from collections import defaultdict

import numpy as np

from terrakite.llm.packing import best_fit, drawn_patterns, fit_repeats, make_plan, pack, patterns, round_repeats


def check(rows, items, windows):
    for name, cap in windows:
        mine = [r for r in rows if r.window_name == name]
        room, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            room[r.container] += r.units
            pieces[r.item].append((r.piece, r.first_unit, r.units))
        assert all(0 < v <= cap for v in room.values())
        assert sorted(room) == list(range(len(room)))
        want = {i: s for i, s in items if i is not None and s is not None and s > 0}
        assert set(pieces) == set(want)
        for i, p in pieces.items():
            p.sort()
            assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == want[i]
            assert len(p) == math.ceil(want[i] / cap)
            assert all(x[2] == cap for x in p[:-1]) and [x[1] for x in p] == [cap * k for k in range(len(p))]
        yield len(room), math.ceil(sum(want.values()) / cap)


def test_every_item_once_and_nothing_overfull(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([rng.randint(1, 40), rng.randint(1, 300), 7])) for i in range(800)] + [(9000, None), (9001, 0), (9002, -4), (None, 5), (9003, 64), (9004, 640)]
    df = spark.createDataFrame([(*x, "c") for x in items], "item bigint, size bigint, container string")
    windows = [("short", 64), ("wide", 256)]
    for used, least in check(pack(df, windows, group_rows=50).collect(), items, windows):
        assert used <= least + 2


def test_empty_items_and_windows(spark):
    none = spark.createDataFrame([], "item bigint, size bigint")
    assert pack(none, [("w", 8)]).collect() == []
    some = spark.createDataFrame([(1, 3)], "item bigint, size bigint")
    assert pack(some, [("w", 0), ("v", None)]).collect() == []
    assert [tuple(r) for r in pack(some, [("w", 8)]).collect()] == [("w", 0, 1, 0, 0, 3)]


def test_patterns_are_all_of_them():
    c, present = 17, np.array([2, 3, 5, 6, 9, 11, 12, 17])
    want = {(17, 0, 0)} | {(a, b, 0) for a in present for b in present if a >= b and a + b == c} | {(a, b, d) for a in present for b in present for d in present if a >= b >= d and a + b + d == c}
    got = {tuple(map(int, p)) for p in patterns(c, present)}
    assert got == {tuple(map(int, p)) for p in want} and len(got) == len(patterns(c, present))


def test_fit_never_uses_more_than_there_is():
    rng = np.random.default_rng(0)
    h = np.zeros(129, np.int64)
    h[rng.integers(1, 129, 60)] = rng.integers(1, 500, 60)
    p = patterns(128, np.flatnonzero(h))
    x = fit_repeats(p, h)
    assert (x >= 0).all()
    chosen, left = round_repeats(p, x, h)
    assert (left >= 0).all() and all(sum(c) == 128 for c, _ in chosen)
    assert chosen, "exact patterns exist for these lengths"
    boxes = best_fit(left)
    again = np.zeros_like(h)
    for made, n in boxes:
        assert sum(v * k for v, k in made) <= 128
        for v, k in made:
            again[v] += k * n
    assert (again == left).all()


def test_one_hot_length():
    h = np.zeros(513, np.int64)
    h[200] = 1_000_003
    plan = make_plan(h)
    assert plan.containers == 500_002
    c = plan.container(np.full(10, 200), np.array([0, 1, 2, 3, 999_999, 1_000_000, 1_000_001, 1_000_002, 5, 4]))
    assert c[0] == c[1] != c[2] and c.max() < plan.containers


def test_most_containers_are_filled_by_patterns_whatever_the_capacity():
    rng = np.random.default_rng(4)
    sizes = np.maximum(1, np.exp(rng.normal(np.log(490), 1.0, 60_000))).astype(int)
    for c in (2048, 16384):
        left = sizes % c
        h = np.bincount(left[left > 0], minlength=c + 1)
        plan = make_plan(h)
        least = -(-int((h * np.arange(c + 1)).sum()) // c)
        assert plan.containers <= least + 2 + least // 500 and plan.by_patterns >= 0.8 * plan.containers


def test_drawn_patterns_are_full():
    h = np.zeros(4097, np.int64)
    h[[3, 50, 77, 210, 999, 2400]] = [900, 500, 400, 300, 90, 20]
    p = drawn_patterns(4096, h, np.random.default_rng(1))
    assert len(p) and (h[p[p > 0]] > 0).all()
    assert ((p.sum(1) <= 4096) & (p.sum(1) >= 4096 - 8)).all()


def test_a_wide_capacity_keeps_few_patterns():
    assert len(patterns(3000, np.arange(1, 3000), most=10_000)) < 40_000
