"""Filling containers of fixed capacity with items of varying length, by packing patterns.

The histogram of lengths is all that the plan needs.  Patterns are choices of lengths that fill a
container: those of one to three lengths are enumerated, those of more are drawn from the histogram and
completed exactly.  Repeat counts are fitted to the histogram by non-negative least squares and
rounded to what it can supply; further rounds draw patterns from what is left.  The residue, items that
no pattern fits any more, is packed by best fit over the histogram.  The plan is bounded by the
capacity and by PATTERN_ITEMS, not by the data.  Items then find their container by their rank among
the items of their length, which is counted in two steps so that a length shared by very many items
is never ranked in one task.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakite.plans.stage import staged

GROUP_ROWS = 50_000
ITERATIONS = 60
PATTERN_ITEMS = 300_000  # items in all patterns of a round
MAX_ITEMS = 1024  # in a drawn pattern
ROUNDS = 10
_RANK_BITS = 44


def patterns(capacity: int, present: np.ndarray, most: int = PATTERN_ITEMS // 3) -> np.ndarray:
    """n x 3 lengths, descending, 0 for none: choices of one to three lengths of `present` with sum `capacity`.

    All of them, unless those of three are more than about `most`: then evenly spaced ones for every largest length.
    """
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    ls = np.flatnonzero(has[1:]) + 1
    out = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    b = capacity - ls
    two = (b >= 1) & (b <= ls)
    two[two] = has[b[two]]
    out.append(np.stack([ls[two], b[two], np.zeros(two.sum(), int)], 1))
    firsts = ls[(ls < capacity) & (3 * ls >= capacity)]
    apart = max(1, len(firsts) * len(ls) // (4 * most))
    for a in firsts:
        left = capacity - a
        x = ls[(ls <= min(a, left - 1)) & (2 * ls >= left)]
        y = left - x
        x = x[has[y]][a % apart :: apart]
        out.append(np.stack([np.full(len(x), a), x, left - x], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def drawn_patterns(capacity: int, histogram: np.ndarray, rng: np.random.Generator, items: int = PATTERN_ITEMS) -> np.ndarray:
    """n x k lengths, 0 for none: patterns drawn from `histogram` (more of what there is more of), each completed to the capacity or almost.

    The first length of a pattern is drawn by the room its items take, so that long ones get their
    complement; of the others, one that leaves a length there is wins over one that does not.
    """
    h = histogram.copy()
    h[0] = 0
    lengths = np.flatnonzero(h)
    if not len(lengths):
        return np.zeros((0, 1), int)
    mean = float((h * np.arange(len(h))).sum()) / float(h.sum())
    k = int(min(MAX_ITEMS, 2 * capacity / mean + 8, capacity))
    n = max(32, int(min(items, 4 * h.sum())) // k)
    cum = np.cumsum(h)
    by_room = np.cumsum(h * np.arange(len(h)))
    room, out = np.full(n, capacity), np.zeros((n, k), np.int64)
    out[:, 0] = np.searchsorted(by_room, (rng.random(n) * by_room[-1]).astype(np.int64), "right")
    room -= out[:, 0]
    for j in range(1, k):
        open_ = np.flatnonzero((room > 0) & (cum[room] > 0))
        if not len(open_):
            break
        r = room[open_]
        pick, last = np.where(h[r] > 0, r, 0), np.zeros(len(r), np.int64)
        for _ in range(6):
            todo = np.flatnonzero(pick == 0)
            if not len(todo):
                break
            a = np.searchsorted(cum, (rng.random(len(todo)) * cum[r[todo]]).astype(np.int64), "right")
            pick[todo] = np.where(h[r[todo] - a] > 0, a, 0)
            last[todo] = a
        pick = np.where(pick == 0, last, pick)
        out[open_, j] = pick
        room[open_] -= pick
    return out[room <= capacity // 512]


def fit_repeats(pats: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """x >= 0 minimising the weighted squares of (uses of each length - histogram), by accelerated projected gradients.

    Short lengths weigh less: left over, they still fit anywhere.
    """
    c = len(histogram) - 1
    weight = np.where(np.arange(c + 1) >= c / 16, 1.0, 0.2)
    weight[0] = 0.0
    flat, k = pats.ravel(), pats.shape[1]

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, k), minlength=c + 1)

    def back(r: np.ndarray) -> np.ndarray:
        return r[pats].sum(1)

    v = np.ones(len(pats))
    for _ in range(12):  # power iteration: the step size
        v = back(weight**2 * use(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.full(len(pats), histogram.sum() / max(1, np.count_nonzero(pats)))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0.0, y - step * back(weight**2 * (use(y) - histogram)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def round_repeats(pats: np.ndarray, x: np.ndarray, histogram: np.ndarray, least: float = 0.5) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts, the nearest to `x` but at least one where `x` is `least` or more, as far as the histogram can supply them, most used patterns first and no more in all than fitted; and what is left of it."""
    left, out, budget = histogram.copy(), [], x.sum() + 1
    for i in np.argsort(-x, kind="stable"):
        if budget < 1 or x[i] < least:
            break
        lengths, times = np.unique(pats[i][pats[i] > 0], return_counts=True)
        n = min(max(1, int(x[i] + 0.5)), int((left[lengths] // times).min()))
        if n:
            budget -= n
            out.append((tuple(int(v) for v in np.repeat(lengths, times)[::-1]), n))
            left[lengths] -= n * times
    return out, left


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit-decreasing over counts: [(((length, times), ...), containers)]."""
    c = len(histogram) - 1
    spaces: list[int] = []  # ascending
    held: dict[int, list] = {}

    def put(space: int, made: tuple, n: int) -> None:
        if space not in held:
            bisect.insort(spaces, space)
            held[space] = []
        held[space].append((made, n))

    for v in np.flatnonzero(histogram)[::-1]:
        v, n = int(v), int(histogram[v])
        while n:
            i = bisect.bisect_left(spaces, v)
            if i == len(spaces):
                per = min(c // v, n)
                boxes = n // per
                put(c - per * v, ((v, per),), boxes)
                n -= boxes * per
                continue
            space = spaces[i]
            made, boxes = held[space].pop()
            if not held[space]:
                del held[space], spaces[i]
            per = min(space // v, n)
            use = min(boxes, n // per)
            if boxes > use:
                put(space, made, boxes - use)
            put(space - per * v, (*made, (v, per)), use)
            n -= use * per
    return [(made, n) for groups in held.values() for made, n in groups]


@dataclass(frozen=True)
class Plan:
    """For a length and a rank among the items of that length, the container: keys sorted by (length, first rank)."""

    keys: np.ndarray
    base: np.ndarray
    per: np.ndarray
    containers: int
    by_patterns: int = 0  # containers filled by patterns; they come first

    def container(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        code = (length.astype(np.int64) << _RANK_BITS) | rank
        at = np.searchsorted(self.keys, code, "right") - 1
        return self.base[at] + (code - self.keys[at]) // self.per[at]


def make_plan(histogram: np.ndarray, seed: int = 11) -> Plan:
    """A plan for `histogram`, the number of items of each length from 0 to the capacity."""
    c = len(histogram) - 1
    full, left = int(histogram[c]), histogram.copy()
    left[c] = left[0] = 0
    rounds, rng = [([], left)], np.random.default_rng(seed)
    for n in range(ROUNDS + 1):
        pats = drawn_patterns(c, left, rng) if n else patterns(c, np.flatnonzero(left))
        if not len(pats):
            continue
        got, left = round_repeats(pats, fit_repeats(pats, left, 25 if n else ITERATIONS), left, 0.0 if n else 0.5)
        rounds.append((rounds[-1][0] + got, left))
        if n and sum(times for _, times in got) * c < 0.02 * float((left * np.arange(c + 1)).sum()):
            break
    made = [sum(times for _, times in chosen) + sum(times for _, times in best_fit(rest)) for chosen, rest in rounds[-1:]]
    room = float((histogram * np.arange(c + 1)).sum())
    if (made[0] + full) * c > 1.005 * room + c:  # long items may lack short ones that patterns took: see after which round the fewest containers come out
        made = [sum(times for _, times in chosen) + sum(times for _, times in best_fit(rest)) for chosen, rest in rounds[:-1]] + made
        rounds = rounds[: len(made) - int(np.argmin(made[::-1]))]
    chosen, left = rounds[-1]
    groups = [(tuple(Counter(p).items()), n) for p, n in chosen]
    by_patterns = sum(n for _, n in groups) + full
    if full:
        groups.append((((c, 1),), full))
    groups += best_fit(left)
    next_rank, rows, base = Counter(), [], 0
    for made, n in groups:
        times = Counter()
        for v, k in made:
            times[v] += k
        for v, k in times.items():
            rows.append(((v << _RANK_BITS) | next_rank[v], base, k))
            next_rank[v] += n * k
        base += n
    rows.sort()
    k, b, p = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return Plan(k, b, p, base, by_patterns)


def _place(plans: dict[str, Plan]):
    def run(batches):
        for b in batches:
            name, cap = b.column("window_name").to_pylist(), b.column("capacity").to_numpy()
            length, rank, times = b.column("len").to_numpy(), b.column("rank").to_numpy(), b.column("times").to_numpy()
            first = b.column("first_piece").to_numpy()
            rows = np.repeat(np.arange(b.num_rows), times)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            container = np.zeros(len(rows), np.int64)
            names = np.array(name, object)[rows]
            for w, plan in plans.items():
                at = np.flatnonzero(names == w)
                if len(at):
                    container[at] = plan.container(length[rows[at]], rank[rows[at]] + nth[at])
            piece = first[rows] + nth
            yield pa.RecordBatch.from_arrays(
                [b.column("window_name").take(pa.array(rows)), pa.array(container), b.column("item").take(pa.array(rows)), pa.array(piece), pa.array(piece * cap[rows]), pa.array(length[rows])],
                ["window_name", "container", "item", "piece", "first_unit", "units"],
            )

    return run


def pack(items: DataFrame, windows: list[tuple[str, int]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """`planned` without its plans."""
    return planned(items, windows, group_rows)[0]


def planned(items: DataFrame, windows: list[tuple[str, int]], group_rows: int = GROUP_ROWS) -> tuple[DataFrame, dict[str, Plan]]:
    """(window_name, container, item, piece, first_unit, units): every item in containers of every window.

    `items`: (item bigint, size bigint).  An item larger than the capacity is cut: whole containers
    first, the rest is packed like any other item; no other item is cut.  Items of size null or
    below 1 take no room and are left out; an item given twice is packed twice.  Containers are numbered
    from 0 in each window, none empty.  `items` is read more than once, so stage it.
    """
    windows = [(n, c) for n, c in windows if n is not None and c is not None and c > 0]
    spark = items.sparkSession
    if not windows:
        return spark.createDataFrame([], "window_name string, container bigint, item bigint, piece bigint, first_unit bigint, units bigint"), {}
    some = items.where("item IS NOT NULL AND size >= 1")
    sides = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in windows])
    each = some.withColumn("w", F.explode(sides)).select("item", "size", "w.*")
    full, rest = F.expr("size div capacity"), F.expr("size % capacity")
    part = lambda length, times, first: F.struct(length.cast("long").alias("len"), times.cast("long").alias("times"), first.cast("long").alias("first_piece"))
    parts = each.withColumn("p", F.explode(F.array(part(F.col("capacity"), full, F.lit(0)), part(rest, F.lit(1), full)))).select("item", "window_name", "capacity", "p.*").where("len > 0 AND times > 0")
    groups = max(1, some.count() // group_rows)
    parts = parts.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    counted = staged(parts.groupBy("window_name", "len", "g").agg(F.sum("times").alias("n")), "lengths")
    plans = {}
    for name, capacity in windows:  # at most `capacity` rows each come to the driver
        h = counted.where(F.col("window_name") == name).groupBy("len").agg(F.sum("n").alias("n")).toArrow()
        histogram = np.zeros(capacity + 1, np.int64)
        histogram[h["len"].to_numpy()] = h["n"].to_numpy()
        plans[name] = make_plan(histogram)
    before = Window.partitionBy("window_name", "len").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("window_name", "len", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("window_name", "len", "g").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("before", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    ranked = ranked.join(offsets, ["window_name", "len", "g"]).withColumn("rank", F.col("offset") + F.col("before"))
    return ranked.mapInArrow(_place(plans), "window_name string, container bigint, item bigint, piece bigint, first_unit bigint, units bigint"), plans


def _packed(spark, sf_dir: str) -> tuple[DataFrame, dict[str, Plan], list[tuple[str, int]], DataFrame]:
    """(placed items, plans, windows, items)."""
    from terrakite.llm.encode import encode_column, vocabulary
    from terrakite.plans.stage import table

    sizes = encode_column(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), "doc_id", "text", vocabulary(), counts_only=True)
    items = staged(sizes.where("n_tokens > 0").select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")), "sizes")
    windows = sorted((r["window_name"], r["capacity_tokens"]) for r in table(spark, sf_dir, "token_windows").distinct().collect())
    placed, plans = planned(items, windows)
    return placed, plans, windows, items


def p7_packing(spark, sf_dir: str) -> DataFrame:
    """Every document with a token in containers of each token window: (window_name, container, doc_id, piece, first_token, n_tokens)."""
    r = _packed(spark, sf_dir)[0]
    return r.select("window_name", "container", F.col("item").alias("doc_id"), "piece", F.col("first_unit").alias("first_token"), F.col("units").alias("n_tokens"))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Per window: containers, tokens, the share of the room that is used, and the share of containers filled by patterns."""
    r, plans, windows, _ = _packed(spark, sf_dir)
    told = spark.createDataFrame([(n, c, plans[n].by_patterns) for n, c in windows], "window_name string, capacity long, by_patterns long")
    f = r.groupBy("window_name").agg((F.max("container") + 1).alias("containers"), F.sum("units").alias("tokens")).join(F.broadcast(told), "window_name")
    used, patterned = F.col("tokens") / (F.col("containers") * F.col("capacity")), F.col("by_patterns") / F.col("containers")
    return f.select("window_name", "containers", "tokens", F.round(used, 6).alias("fill"), F.round(patterned, 6).alias("by_patterns"))


def p7_check(spark, sf_dir: str) -> DataFrame:
    """Per window, what must be none: containers beyond the capacity, containers without anything, documents whose tokens are not all there once, and documents cut though they fit."""
    r, _, windows, items = _packed(spark, sf_dir)
    r = staged(r, "placed")
    room = spark.createDataFrame(windows, "window_name string, capacity long")
    box = r.groupBy("window_name", "container").agg(F.sum("units").alias("units")).join(F.broadcast(room), "window_name")
    box = box.groupBy("window_name").agg(F.count_if(F.col("units") > F.col("capacity")).alias("overfull"), (F.max("container") + 1 - F.count("*")).alias("empty"))
    piece = r.groupBy("window_name", "item").agg(F.sum("units").alias("units"), F.count("*").alias("pieces"), F.countDistinct("first_unit").alias("firsts"))
    want = items.groupBy("item").agg(F.sum("size").alias("size")).crossJoin(F.broadcast(room))  # the windows are a few
    both = want.join(piece, ["window_name", "item"], "full")
    whole = both.groupBy("window_name").agg(
        F.count_if(~F.coalesce((F.col("units") == F.col("size")) & (F.col("firsts") == F.col("pieces")), F.lit(False))).alias("not_once"), F.count_if((F.col("size") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut")
    )
    return box.join(whole, "window_name").select("window_name", *[F.col(c).cast("long").alias(c) for c in ("overfull", "empty", "not_once", "cut")])


CHECK_SQL = "SELECT window_name, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS not_once, CAST(0 AS BIGINT) AS cut FROM (SELECT DISTINCT window_name FROM token_windows)"
