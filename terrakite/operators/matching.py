"""Descriptor matching: exact k nearest, ratio test, fallback order, feature selection, match-or-create."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakite.plans.stage import numbered

MAX_DISTANCE = 210.0
RATIO = 0.99
LARGE_SIZE = 3.5
MAX_FEATURES = 16384
BLOCK_ROWS = 4096


def k_nearest(queries: DataFrame, train: DataFrame, k: int, query_key: str, train_key: str, vector: str, group: str | None = None, radius: float | None = None) -> DataFrame:
    """(query_key, train_key, distance, rank): the k nearest train rows of every query row by Euclidean distance, exact.

    Both sides are cut into blocks by key; a pair of blocks is one matrix product, whose few best per query are
    measured exactly, and the survivors of all blocks are ranked.  `group`: a column of both sides; only rows of
    one group are compared (the spatial candidates of an image, say), and blocks are counted in each group, so
    a row goes only to the blocks of its own.  `radius`: only rows at most so far.  Equal distances go to the
    smaller key; rows of one key and vector count once.  Null keys or vectors take no part; vectors of
    another length than the query's are no candidates.
    """
    g = F.col(group).cast("string") if group else F.lit("")
    side = lambda df, key, is_q: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & g.isNotNull()).select(g.alias("g"), F.lit(is_q).alias("q"), F.col(key).cast("long").alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    q, t = side(queries, query_key, True), side(train, train_key, False)
    count = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    blocks = count(q, "nq").join(count(t, "nt"), "g")  # groups that one side lacks go with the join
    if not group:
        blocks = F.broadcast(blocks)  # one row
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(blocks, "g").withColumn("bq", mine("nq")).withColumn("bt", every("nt"))
    t = t.join(blocks, "g").withColumn("bt", mine("nt")).withColumn("bq", every("nq"))
    columns = ["g", "q", "key", "v", "bq", "bt"]

    def block(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        qs, ts = df[df.q], df[~df.q].sort_values("key")
        out = []
        for length, part in qs.groupby(qs.v.map(len)):
            cand = ts[ts.v.map(len) == length]
            if not len(cand) or not length:
                continue
            a, b, of, keys = np.stack(part.v.to_numpy()), np.stack(cand.v.to_numpy()), part.key.to_numpy(), cand.key.to_numpy()
            again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (b[1:] == b[:-1]).all(1)])
            b, keys = b[~again], keys[~again]
            row, col, d = _nearest(a, b, k + int((keys[1:] == keys[:-1]).sum()), radius)
            found = pd.DataFrame({query_key: of[row], train_key: keys[col], "distance": d}).sort_values([query_key, "distance", train_key])
            out.append(found.drop_duplicates([query_key, train_key]).groupby(query_key).head(k))
        return pd.concat(out) if out else pd.DataFrame({query_key: pd.Series(dtype="int64"), train_key: pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})

    found = q.select(columns).unionByName(t.select(columns)).groupBy("g", "bq", "bt").applyInPandas(block, f"{query_key} long, {train_key} long, distance double")
    found = found.groupBy(query_key, train_key).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(query_key).orderBy("distance", train_key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(a: np.ndarray, b: np.ndarray, k: int, radius: float | None, cells: int = 8_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of at least the k nearest of each row, ties included."""
    an, bn, out = (a * a).sum(1), (b * b).sum(1), []
    slack = 1e-9 * (an.max(initial=0.0) + bn.max(initial=0.0)) + 1e-12  # what the product may be off by
    for s in range(0, len(a), max(1, cells // max(len(b), 1))):
        x = a[s : s + max(1, cells // max(len(b), 1))]
        g = an[s : s + len(x), None] + bn - 2 * (x @ b.T)
        most = np.partition(g, k - 1, axis=1)[:, k - 1] if k < len(b) else np.full(len(x), np.inf)
        if radius is not None:
            most = np.minimum(most, radius * radius)
        row, col = np.nonzero(g <= (most + 2 * slack)[:, None])
        d = np.sqrt(((x[row] - b[col]) ** 2).sum(1))
        ok = d <= radius if radius is not None else np.ones(len(d), bool)
        out.append((row[ok] + s, col[ok], d[ok]))
    return tuple(np.concatenate(v) for v in zip(*out))


def split_matches(neighbours: DataFrame, query_key: str, max_distance: float = MAX_DISTANCE, ratio: float = RATIO) -> DataFrame:
    """`neighbours` that are accepted, with `passed`.

    passed: the nearest, if it is closer than `max_distance` and than `ratio` times the second.
    Otherwise the leading neighbours no farther than `max_distance` that are near ties of the
    nearest (d1 >= ratio * d) stay, with passed false.  A query with a single neighbour never passes.
    """
    w = Window.partitionBy(query_key)
    first = F.min("distance").over(w)
    second = F.max(F.when(F.col("rank") == 2, F.col("distance"))).over(w)
    n = neighbours.withColumn("_d1", first).withColumn("_d2", second)
    ok = F.coalesce((F.col("_d1") < max_distance) & (F.col("_d1") < ratio * F.col("_d2")), F.lit(False))
    bad = (F.col("distance") > max_distance) | (F.col("_d1") < ratio * F.col("distance"))
    n = n.withColumn("passed", ok).withColumn("_bad", F.min(F.when(bad, F.col("rank"))).over(w))
    keep = (F.col("passed") & (F.col("rank") == 1)) | (~F.col("passed") & (F.col("_bad").isNull() | (F.col("rank") < F.col("_bad"))))
    return n.where(keep).drop("_bad")


def match_order(split: DataFrame, sizes: DataFrame, query_key: str, train_key: str, per: str | None = None) -> DataFrame:
    """`split` with `position` from 1: the passed by rising d1/d2, then the others, those of large features by distance first, the rest by falling size.

    Ties go to the smaller query and train key.  `per`: a column (an image) within which matches are ordered.
    """
    j = split.join(sizes.select(query_key, F.col("size").alias("_size")), query_key)
    large = F.col("_size") > LARGE_SIZE
    order = [
        (~F.col("passed")).cast("int"),
        F.coalesce(F.when(F.col("passed"), F.col("_d1") / F.when(F.col("_d2") > 0, F.col("_d2"))), F.lit(float("inf"))),
        F.when(~F.col("passed"), (~large).cast("int")),
        F.when(~F.col("passed") & large, F.col("distance")),
        F.when(~F.col("passed") & ~large, -F.col("_size")),
        F.col(query_key),
        F.col(train_key),
    ]
    if per is None:
        return numbered(j, "position", *order).drop("_d1", "_d2", "_size")
    return j.withColumn("position", F.row_number().over(Window.partitionBy(per).orderBy(*order))).drop("_d1", "_d2", "_size")


def top_features(keypoints: DataFrame, image: str, size: str = "size", index: str | tuple[str, ...] = "seq", most: int = MAX_FEATURES, least_size: float | None = None) -> DataFrame:
    """The `most` largest features of each image, ties to the smaller index; with `least_size` only those no smaller."""
    some = keypoints if least_size is None else keypoints.where(F.col(size) >= least_size)
    w = Window.partitionBy(image).orderBy(F.desc(size), *((index,) if isinstance(index, str) else index))
    return some.withColumn("feature_rank", F.row_number().over(w)).where(F.col("feature_rank") <= most)


def match_or_create(features: DataFrame, matches: DataFrame, landmarks: DataFrame, query_key: str, match_key: str) -> tuple[DataFrame, DataFrame]:
    """(links, landmarks): every feature linked to its matched landmark, or to a new one.

    `features`: query_key and x, y, z, where a landmark for it would stand; `matches`: (query_key,
    match_key), at most one row a feature; `landmarks`: id, x, y, z.  New ids follow the largest
    one in order of query_key.
    """
    linked = features.join(matches.select(query_key, match_key), query_key, "inner").select(query_key, F.col(match_key).alias("landmark_id"), F.lit(False).alias("created"))
    new = features.join(matches.select(query_key), query_key, "left_anti")
    top = F.broadcast(landmarks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    given = numbered(new, "_n", query_key).crossJoin(top).withColumn("landmark_id", F.col("_top") + F.col("_n"))
    links = linked.unionByName(given.select(query_key, "landmark_id", F.lit(True).alias("created")))
    return links, landmarks.select("id", "x", "y", "z").unionByName(given.select(F.col("landmark_id").alias("id"), "x", "y", "z"))


