"""Shortest paths over the navigation graph, and the two service calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.functions.rects import Rect
from terrakite.operators.spatial import find
from terrakite.plans.stage import discard, staged


def weighted_edges(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): edges between known anchors, with the distance of their positions; copies once."""
    a = anchors.select(F.col("id").alias("src"), F.struct("x", "y", "z").alias("a"))
    b = anchors.select(F.col("id").alias("dst"), F.struct("x", "y", "z").alias("b"))
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "yz"), (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x"))))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("src", "dst", d.alias("w"))


def shortest_costs(anchors: DataFrame, edges: DataFrame, start: int, cut_every: int = 4) -> DataFrame:
    """(id, cost, via): least cost from `start` to every anchor it reaches, and the anchor before.

    The frontier of improved anchors is relaxed until none improves; costs are kept in a table that is
    written every `cut_every` rounds, so the plan stays short and an executor can be lost.  An unknown
    start reaches nothing.
    """
    w = staged(weighted_edges(anchors, edges), "edges")
    best = anchors.where(F.col("id") == start).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via"))
    best, n = staged(best, "costs"), 0
    frontier, held = best, [best]  # the tables that `best` is made of
    while True:
        step = frontier.join(w, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("via"))
        offer = step.groupBy("id").agg(F.min(F.struct("cost", "via")).alias("o")).select("id", "o.cost", "o.via")
        old = best.select("id", F.col("cost").alias("_old"))
        better = staged(offer.join(old, "id", "left").where(F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).select("id", "cost", "via"), "frontier")
        if better.isEmpty():
            return best
        best = best.join(better.select("id"), "id", "left_anti").unionByName(better)
        n += 1
        held.append(better)
        if n % cut_every == 0:
            best = staged(best, "costs")
            discard(*held[:-1])  # the frontier is still read
            held = [better, best]
        frontier = better


def path(anchors: DataFrame, edges: DataFrame, start: int, goal: int) -> DataFrame:
    """(step, id, x, y, z) along the cheapest path from `start` to `goal`, step from 0.

    start = goal gives one row, an unreachable or unknown goal none.  Of equal paths the one with
    the smaller predecessor at each anchor is taken.
    """
    costs = staged(shortest_costs(anchors, edges, start), "costs")
    ids, at = [], goal
    while at is not None:  # one lookup a step of the answer
        row = costs.where(F.col("id") == at).select("via").head()
        if row is None:
            ids = []
            break
        ids.append(at)
        at = None if at == start else row["via"]
    rows = [(i, k) for i, k in enumerate(reversed(ids))]
    found = anchors.sparkSession.createDataFrame(rows, "step int, id long")
    return found.join(anchors.select("id", "x", "y", "z"), "id").select("step", "id", "x", "y", "z")


def get_path(anchors: DataFrame, edges: DataFrame, start: int, goal: int) -> dict:
    """The service answer: found, and the anchors in order."""
    rows = path(anchors, edges, start, goal).orderBy("step").collect()
    return {"found": bool(rows), "anchors": [(r.id, r.x, r.y, r.z) for r in rows]}


def get_landmarks(landmarks: DataFrame, lx: float, lz: float, ux: float, uz: float, limit: int = 0) -> DataFrame:
    """Landmarks that touch a rectangle; limit -1 gives all, and 0, which stands for an unset limit, none."""
    return find(landmarks, Rect.of(lx, lz, ux, uz), limit)
