"""Most similar vectors for every vector: a hash-prefix forest over byte vectors.

Every vector gets long hash strings.  Their first character, the largest of many rotated coordinates
and its sign, decides the partition; only a branch too large for the memory of one task is cut by further
characters of the same kind, as every cut parts neighbours.  A few such partitionings, by different rotations, make
it likely that neighbours meet.  Vectors go to them in compressed chunks.  In a partition a forest of LOCAL_TREES trees,
others in each partitioning, stands over its landmarks: a sorted array of strings each, of
characters from pairs of further coordinates.  A query descends every tree to its longest matching prefix
and ascends all of them together, a character at a time, until at least MIN_CANDIDATES lie below its nodes.
Distances to the candidates are exact integers from one matrix product for all queries at a node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 128
ROOT_DIMS = 64  # the first character has 2 * ROOT_DIMS values
CUT_DIMS = 16  # the characters that cut large branches have 2 * CUT_DIMS values
LOCAL_TREES = 6
LEVELS = 12  # characters of a local string, 4 values each
MIN_CANDIDATES = 1024
BLOCK_ROWS = 50_000
LANDMARKS_MOST, QUERIES_MOST = 7, 10  # BLOCK_ROWS that one task holds; a branch of more landmarks is cut
CHUNK_ROWS = 65_536  # rows that are dealt out to chunks together
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 2_000
NEAR = 0.68  # chance that a true neighbour shares the first character, where the samples have too few neighbours to measure it
NEAR_CUT = 0.78  # the same for a second or third character, given those before it
NEAR_PAIRS = 500
LEAST_PARTITIONINGS = 4
MOST_PARTITIONINGS = 12
TARGET_RECALL = 0.96
GROUP_ROWS = 20_000


def _polytope(y: np.ndarray) -> np.ndarray:
    """A character of each row: the place and sign of its largest coordinate."""
    at = np.argmax(np.abs(y), axis=1)
    return 2 * at + (y[np.arange(len(y)), at] > 0)


@dataclass(frozen=True)
class Forest:
    """Centre and rotations, which branches of each partitioning are cut by a second and a third character, and into how many blocks what is still too large is split."""

    centre: np.ndarray
    rotations: np.ndarray  # partitionings x DIM x (ROOT_DIMS + 2 * CUT_DIMS)
    cut: np.ndarray  # partitionings x roots
    cut_again: np.ndarray  # partitionings x roots x second characters
    local: np.ndarray  # partitionings x DIM x (LOCAL_TREES * LEVELS * 2)
    landmark_blocks: np.ndarray  # partitionings x roots
    query_blocks: np.ndarray

    @property
    def partitionings(self) -> int:
        return len(self.rotations)

    def parts(self, v: np.ndarray, t: int) -> np.ndarray:
        """The partition of each row of `v` in partitioning `t`."""
        y = (v.astype(np.float32) - self.centre) @ self.rotations[t]
        a, b, c = _polytope(y[:, :ROOT_DIMS]), _polytope(y[:, ROOT_DIMS : ROOT_DIMS + CUT_DIMS]), _polytope(y[:, ROOT_DIMS + CUT_DIMS :])
        more = self.cut[t, a]
        most = more & self.cut_again[t, a, b]
        return (a << 16) | np.where(more, (b + 1) << 8, 0) | np.where(most, c + 1, 0)

    def strings(self, v: np.ndarray, t: int = 0) -> np.ndarray:
        """LOCAL_TREES x rows: the local strings of partitioning `t` as numbers in base 4."""
        out = np.zeros((LOCAL_TREES, len(v)), np.int64)
        for s in range(0, len(v), 8192):
            x = v[s : s + 8192]
            y = ((x.astype(np.float32) - self.centre) @ self.local[t]).reshape(len(x), LOCAL_TREES, LEVELS, 2)
            a, b = y[..., 0], y[..., 1]
            second = np.abs(b) > np.abs(a)
            char = 2 * second + (np.where(second, b, a) > 0)
            out[:, s : s + 8192] = (char.astype(np.int64) << (2 * np.arange(LEVELS)[::-1])).sum(axis=2).T
        return out


def partitionings_for(near: float) -> int:
    """How many partitionings find TARGET_RECALL of the neighbours, if one finds `near` of them."""
    return min(MOST_PARTITIONINGS, max(3, math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - min(near, 0.99)))))


def fit_forest(landmark_sample: np.ndarray, query_sample: np.ndarray, landmarks: int, queries: int, k: int = 8, radius: float = 150.0, seed: int = 5) -> Forest:
    """A forest for so many landmarks.

    The samples (SAMPLE_ROWS and SAMPLE_QUERIES at most) give the centre, the sizes of the branches, and how
    often a query and its neighbours in the sample share a partition, which says how many partitionings
    are needed.  Neighbours in a sample lie farther than those among all rows, so the share errs on the low side.
    """
    centre = landmark_sample.astype(np.float64).mean(axis=0).astype(np.float32) if len(landmark_sample) else np.zeros(DIM, np.float32)
    rng = np.random.default_rng(seed)
    turn = lambda: np.linalg.qr(rng.standard_normal((DIM, DIM)))[0].astype(np.float32)
    rotations = np.stack([turn()[:, : ROOT_DIMS + 2 * CUT_DIMS] for _ in range(MOST_PARTITIONINGS)])
    local = np.stack([np.concatenate([turn()[:, : 2 * LEVELS] for _ in range(LOCAL_TREES)], axis=1) for _ in range(MOST_PARTITIONINGS)])
    roots, cuts = 2 * ROOT_DIMS, 2 * CUT_DIMS
    rows_of_one = landmarks / max(len(landmark_sample), 1)
    cut, cut_again = np.zeros((MOST_PARTITIONINGS, roots), bool), np.zeros((MOST_PARTITIONINGS, roots, cuts), bool)
    for t in range(MOST_PARTITIONINGS):
        y = (landmark_sample.astype(np.float32) - centre) @ rotations[t]
        a, b = _polytope(y[:, :ROOT_DIMS]), _polytope(y[:, ROOT_DIMS : ROOT_DIMS + CUT_DIMS])
        cut[t] = np.bincount(a, minlength=roots) * rows_of_one > LANDMARKS_MOST * BLOCK_ROWS
        cut_again[t] = np.bincount(a * cuts + b, minlength=roots * cuts).reshape(roots, cuts) * rows_of_one > LANDMARKS_MOST * BLOCK_ROWS
    one = np.ones((MOST_PARTITIONINGS, roots), int)
    whole = Forest(centre, rotations, cut, cut_again, local, one, one)

    def blocks(sample: np.ndarray, rows: int, most: int, whole_up_to: int) -> np.ndarray:
        """Blocks of `most` rows for what has more than `whole_up_to`: a block costs copies of all rows of the other side."""
        out = one.copy()
        for t in range(MOST_PARTITIONINGS if len(sample) else 0):
            part, n = np.unique(whole.parts(sample, t), return_counts=True)
            n = n * (rows / len(sample))
            np.maximum.at(out[t], part >> 16, np.where(n > whole_up_to, np.ceil(n / most), 1).astype(int))
        return out

    q, i, _ = k_nearest(query_sample, landmark_sample, np.arange(len(landmark_sample)), k, radius)
    cuts_of_row = [(whole.parts(landmark_sample, t)[:, None] >> np.array([8, 0]) & 255 > 0).sum(1) for t in range(4)]
    near = NEAR * float(np.mean(NEAR_CUT ** np.concatenate(cuts_of_row))) if len(landmark_sample) else NEAR
    if len(q) >= NEAR_PAIRS:
        near = float(np.mean([np.mean(whole.parts(query_sample, t)[q] == whole.parts(landmark_sample, t)[i]) for t in range(4)]))
    n = max(LEAST_PARTITIONINGS, partitionings_for(near))
    landmark_blocks, query_blocks = blocks(landmark_sample, landmarks, 2 * BLOCK_ROWS, LANDMARKS_MOST * BLOCK_ROWS), blocks(query_sample, queries, 4 * BLOCK_ROWS, QUERIES_MOST * BLOCK_ROWS)
    return Forest(centre, rotations[:n], cut[:n], cut_again[:n], local[:n], landmark_blocks[:n], query_blocks[:n])


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of DIM bytes from a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIM)


_CHUNK = "part bigint, landmark boolean, size int, data binary"
_ROW_BYTES = 8 + 4 + DIM


def _packed(owner: np.ndarray, row_no: np.ndarray, v: np.ndarray) -> bytes:
    """Compressed rows: all owners, all row numbers, all vectors."""
    return pa.compress(owner.astype("<i8").tobytes() + row_no.astype("<i4").tobytes() + np.ascontiguousarray(v).tobytes(), codec="zstd", asbytes=True)


def _unpacked(t: pa.Table, landmark: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, row_no, vectors) of the chunks of one side."""
    size, at = t.column("size").to_numpy(), np.flatnonzero(t.column("landmark").to_numpy() == landmark)
    ends = np.concatenate([[0], np.cumsum(size[at])])
    owner, row_no, v = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int32), np.empty((ends[-1], DIM), np.uint8)
    data = t.column("data")
    for i, s, e in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        n, raw = e - s, pa.decompress(data[i].as_buffer(), decompressed_size=(e - s) * _ROW_BYTES, codec="zstd")
        owner[s:e], row_no[s:e] = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n)
        v[s:e] = np.frombuffer(raw, np.uint8, DIM * n, 12 * n).reshape(n, DIM)
    return owner, row_no, v


def _spread(forest: Forest, landmark: bool, owner: np.ndarray, row_no: np.ndarray, v: np.ndarray):
    """One batch of chunks a partitioning: every vector in its partition.

    Of a partition still too large after its cuts, as one of a crowd of near-equal vectors is, the landmarks
    of a block meet every block of queries, and the other way round, so nothing is lost.
    """
    mine, other = (forest.landmark_blocks, forest.query_blocks) if landmark else (forest.query_blocks, forest.landmark_blocks)
    mix = (owner.astype(np.uint64) * np.uint64(1_000_003) + row_no.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    for t in range(forest.partitionings):
        part = forest.parts(v, t)
        copies = other[t, part >> 16]
        at = np.repeat(np.arange(len(v)), copies)
        there = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        here = (mix % mine[t, part >> 16].astype(np.uint64)).astype(np.int64)[at]
        lb, qb = (here, there) if landmark else (there, here)
        key = (((t << 24) | part[at]) << 32) | (lb << 16) | qb
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        chunks = [_packed(owner[i], row_no[i], v[i]) for i in (at[s:e] for s, e in zip(cuts[:-1], cuts[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]]), pa.array(np.full(len(chunks), landmark)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(chunks, pa.binary())], ["part", "landmark", "size", "data"])


def _joined(batches):
    """Tables of CHUNK_ROWS rows or more, the last one of what is left."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _spread_landmarks(forest: Forest, k: int):
    def run(batches):
        for b in _joined(batches):
            ids, v = b.column("id").to_numpy(), _vectors(b.column("vec"))
            # of equal vectors only the k smallest ids can be among the k nearest of anything
            _, same = np.unique(v.view(f"V{DIM}").ravel(), return_inverse=True)
            order = np.lexsort((ids, same))
            s, i = same[order], ids[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
            order, s = order[new], s[new]
            first = np.searchsorted(s, s)
            order = order[np.arange(len(s)) - first < k]
            yield from _spread(forest, True, ids[order], np.zeros(len(order), np.int64), v[order])

    return run


def _explode_queries(forest: Forest):
    def run(batches):
        held, rows = [], 0
        for b in batches:
            for o, d in zip(b.column("owner").to_pylist(), b.column("vec").to_pylist()):
                held.append((o, np.frombuffer(d, np.uint8).reshape(-1, DIM)))
                rows += len(held[-1][1])
                if rows >= CHUNK_ROWS:
                    yield from _emit(forest, held)
                    held, rows = [], 0
        yield from _emit(forest, held)

    return run


def _emit(forest: Forest, held: list):
    if held:
        owner = np.repeat(np.array([o for o, _ in held], np.int64), [len(v) for _, v in held])
        row_no = np.concatenate([np.arange(len(v)) for _, v in held])
        yield from _spread(forest, False, owner, row_no, np.concatenate([v for _, v in held]))


def ranges(sorted_strings: np.ndarray, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of `sorted_strings` that share its first `depth` characters."""
    shift = 2 * (LEVELS - depth)
    q = queries >> shift << shift
    return np.searchsorted(sorted_strings, q, "left"), np.searchsorted(sorted_strings, q + (1 << shift), "left")


def ascend(landmark_strings: np.ndarray, query_strings: np.ndarray, least: int) -> np.ndarray:
    """For each query the depth at which it stops: the deepest one, the same in every tree, where its nodes hold `least` landmarks together; 0 if none does.

    `landmark_strings`: trees x landmarks, each row sorted; `query_strings`: trees x queries.
    """
    depth = np.zeros(query_strings.shape[1], np.int64)
    open_ = np.arange(query_strings.shape[1])
    for d in range(LEVELS, 0, -1):
        held = np.zeros(len(open_), np.int64)
        for ls, qs in zip(landmark_strings, query_strings):
            lo, hi = ranges(ls, qs[open_], d)
            held += hi - lo
        depth[open_[held >= least]] = d
        open_ = open_[held < least]
    return depth


def k_nearest(q: np.ndarray, landmarks: np.ndarray, ids: np.ndarray, k: int, radius: float, cells: int = 12_000_000):
    """(query, id, squared distance) of the up to k nearest within `radius`; all sums are integers below 2**24, so float32 is exact."""
    l32, q32 = landmarks.astype(np.float32), q.astype(np.float32)
    ln, qn, most = (l32 * l32).sum(1), (q32 * q32).sum(1), np.float32(math.floor(radius * radius))
    out, chunk = [], max(32, cells // max(len(l32), 1))
    for s in range(0, len(q), chunk):
        g = q32[s : s + chunk] @ l32.T
        g *= -2
        g += ln
        a, b = np.nonzero(g <= (most - qn[s : s + chunk])[:, None])
        d = (g[a, b] + qn[s + a]).astype(np.int64)
        order = np.lexsort((ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((a[keep] + s, ids[b[keep]], d[keep]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def forest_nearest(forest: Forest, q: np.ndarray, landmarks: np.ndarray, ids: np.ndarray, k: int, radius: float, least: int, t: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the up to k nearest candidates within `radius`: the landmarks below the nodes where each query stops in every tree of partitioning `t`, or all where it stops at the root."""
    if not len(q) or not len(landmarks):
        return (np.zeros(0, np.int64),) * 3
    ls = forest.strings(landmarks, t)
    order = np.argsort(ls, axis=1, kind="stable").astype(np.int32)
    ls = np.take_along_axis(ls, order, axis=1)
    ln = np.concatenate([np.square(landmarks[s : s + 8192], dtype=np.float32).sum(1) for s in range(0, len(landmarks), 8192)])
    out = []
    for s in range(0, len(q), BLOCK_ROWS):
        a, i, d = _block_nearest(q[s : s + BLOCK_ROWS], forest.strings(q[s : s + BLOCK_ROWS], t), landmarks, ln, ls, order, ids, k, radius, least)
        out.append((a + s, i, d))
    return tuple(np.concatenate(x) for x in zip(*out))


def _block_nearest(q, qs, landmarks, ln, ls, order, ids, k, radius, least):
    """forest_nearest for a block of queries and their strings; vectors are made floats a node at a time."""
    depth = ascend(ls, qs, least)
    top, found = np.flatnonzero(depth == 0), []
    for s in range(0, len(landmarks) if len(top) else 0, BLOCK_ROWS):
        part = landmarks[s : s + BLOCK_ROWS]
        a, b, d = k_nearest(q[top], part, np.arange(len(part)), len(part), radius)
        found.append((top[a], b + s, d))
    qn, most = np.square(q, dtype=np.float32).sum(1), np.float32(math.floor(radius * radius))
    for tree in range(LOCAL_TREES):
        for at_depth in np.unique(depth[depth > 0]):
            mine = np.flatnonzero(depth == at_depth)
            lo, hi = ranges(ls[tree], qs[tree, mine], at_depth)
            by = np.argsort(lo, kind="stable")
            mine, lo, hi = mine[by], lo[by], hi[by]
            cuts = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1], [True]]))
            for s, e in zip(cuts[:-1], cuts[1:]):
                if lo[s] == hi[s]:
                    continue
                below = order[tree, lo[s] : hi[s]]
                g = q[mine[s:e]].astype(np.float32) @ landmarks[below].astype(np.float32).T
                g *= -2
                g += ln[below]
                a, b = np.nonzero(g <= (most - qn[mine[s:e]])[:, None])
                found.append((mine[s:e][a], below[b].astype(np.int64), (g[a, b] + qn[mine[s:e][a]]).astype(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, d = (np.concatenate(x) for x in zip(*found))
    _, one = np.unique(a * len(landmarks) + b, return_index=True)  # a candidate of several trees counts once
    a, b, d = a[one], b[one], d[one]
    by = np.lexsort((ids[b], d, a))
    a, b, d = a[by], b[by], d[by]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], ids[b[keep]], d[keep]


def _once(at: np.ndarray, owner: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The rows `at` without those that repeat an owner and its vector: copies must not take the places of others."""
    at = at[np.argsort(owner[at], kind="stable")]
    again = np.flatnonzero(owner[at][1:] == owner[at][:-1]) + 1
    drop, seen = [], {}
    for i in again:
        of = seen.setdefault(int(owner[at[i]]), {v[at[i - 1]].tobytes()})
        if (this := v[at[i]].tobytes()) in of:
            drop.append(i)
        of.add(this)
    return np.delete(at, drop)


def _match(forest: Forest, k: int, radius: float, least: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, _, lv = _unpacked(t, True)
        owner, row_no, v = _unpacked(t, False)
        at = _once(np.arange(len(ids)), ids, lv)
        # paths are longer in a large partition, so more neighbours leave them
        q, i, d = forest_nearest(forest, v, lv[at], ids[at], k, radius, least * (2 if len(at) > BLOCK_ROWS else 1), key[0].as_py() >> 56)
        return pa.table({"owner": owner[q], "row_no": row_no[q].astype(np.int64), "id": i, "d2": d})

    return run


def similar_vectors(queries: DataFrame, landmarks: DataFrame, k: int = 8, radius: float = 150.0, min_candidates: int = MIN_CANDIDATES) -> DataFrame:
    """(owner, row_no, id, d2): the up to `k` landmarks nearest to each query vector, at most `radius` away.

    `queries`: (owner bigint, vec binary), vec being any number of 128-byte vectors, numbered from 0
    in row_no; `landmarks`: (id bigint, vec binary).  Rows with a null, or whose bytes are not whole
    vectors (landmarks: not exactly one), take no part.  Equal distances go to the smaller id.  Copies
    of an owner or an id change nothing.  The search is approximate: a neighbour that shares no
    partition with the query, or none of the nodes where the query stops, is lost (tests and README: recall).
    Empty tables give no rows.
    """
    q = queries.where(F.col("owner").isNotNull() & (F.length("vec") > 0) & (F.length("vec") % DIM == 0)).select("owner", "vec")
    lm = landmarks.where(F.col("id").isNotNull() & (F.length("vec") == DIM)).select("id", "vec")
    n_l = landmarks.count()
    n_q, q_rows = q.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0)) / DIM).first()
    sample = lambda df, n, most: _vectors(df.select("vec").sample(min(1.0, most / max(n, 1)), seed=3).limit(2 * most).toArrow().column(0))
    ls = sample(lm, n_l, SAMPLE_ROWS)
    one = q.select(F.expr(f"substring(vec, 1 + {DIM} * (abs(hash(owner)) % (length(vec) div {DIM})), {DIM})").alias("vec"))  # one vector of each, so that whole blobs stay where they are
    forest = fit_forest(ls, sample(one, n_q, SAMPLE_QUERIES), n_l, int(q_rows), k, radius)
    spread = lm.mapInArrow(_spread_landmarks(forest, k), _CHUNK).unionAll(q.mapInArrow(_explode_queries(forest), _CHUNK))
    parts = max(1, math.ceil(forest.partitionings * (n_l + q_rows) / GROUP_ROWS))
    spread = spread.repartition(max(parts, int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    found = spread.groupBy("part").applyInArrow(_match(forest, k, radius, min_candidates), "owner bigint, row_no bigint, id bigint, d2 bigint")
    once = found.groupBy("owner", "row_no", "id").agg(F.min("d2").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("owner", "row_no").orderBy("d2", "id"))
    return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _exact(k: int, radius: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        of_landmark, owner, row_no, v = t.column("landmark").to_numpy(), t.column("owner").to_numpy(), t.column("row_no").to_numpy(), _vectors(t.column("vec"))
        l_at, q_at = _once(np.flatnonzero(of_landmark), owner, v), np.flatnonzero(~of_landmark)
        q, i, d = k_nearest(v[q_at], v[l_at], owner[l_at], k, radius)
        return pa.table({"owner": owner[q_at[q]], "row_no": row_no[q_at[q]].astype(np.int64), "id": i, "d2": d})

    return run


def exact_vectors(queries: DataFrame, landmarks: DataFrame, k: int = 8, radius: float = 150.0) -> DataFrame:
    """As similar_vectors, but exact: every block of the queries meets every block of the landmarks.  For a stated query set, to measure recall."""
    q = queries.where(F.col("owner").isNotNull() & (F.length("vec") > 0) & (F.length("vec") % DIM == 0)).select("owner", "vec")
    rows = q.select("owner", F.posexplode(F.sequence(F.lit(0), F.expr(f"CAST(length(vec) div {DIM} AS INT) - 1"))).alias("row_no", "_"), "vec")
    one = rows.select("owner", "row_no", F.lit(False).alias("landmark"), F.expr(f"substring(vec, 1 + {DIM} * row_no, {DIM})").alias("vec"))
    lm = landmarks.where(F.col("id").isNotNull() & (F.length("vec") == DIM)).select(F.col("id").alias("owner"), F.lit(0).alias("row_no"), F.lit(True).alias("landmark"), "vec")
    blocks = lambda n, most: max(1, -(-n // most))
    nq, nl = blocks(one.count(), BLOCK_ROWS // 4), blocks(lm.count(), BLOCK_ROWS)
    mine = lambda n: F.pmod(F.xxhash64("owner", "row_no"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = one.withColumn("qb", mine(nq)).withColumn("lb", every(nl)).unionByName(lm.withColumn("lb", mine(nl)).withColumn("qb", every(nq)))
    found = both.groupBy("qb", "lb").applyInArrow(_exact(k, radius), "owner bigint, row_no bigint, id bigint, d2 bigint").distinct()
    rank = F.row_number().over(Window.partitionBy("owner", "row_no").orderBy("d2", "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, landmarks)."""
    from terrakite.plans.stage import table

    d = table(spark, sf_dir, "descriptors").where("cols = 128 AND `rows` IS NOT NULL AND length(data) = `rows` * 128")
    q = d.select(F.col("image_id").cast("long").alias("owner"), F.col("data").alias("vec"))
    return q, table(spark, sf_dir, "landmarks").select("id", F.col("desc").alias("vec"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The landmarks most like each descriptor of each image."""
    return similar_vectors(*_tables(spark, sf_dir)).select(F.col("owner").alias("image_id"), "row_no", F.col("id").alias("landmark_id"))


def _hundredth(lm: DataFrame) -> DataFrame:
    return lm.where("id % 100 = 0").select(F.col("id").alias("owner"), "vec").distinct()


def p2_exact(spark, sf_dir: str) -> DataFrame:
    """The exact answer for the landmarks whose id is divisible by 100, against all landmarks."""
    lm = _tables(spark, sf_dir)[1]
    return exact_vectors(_hundredth(lm), lm).select(F.col("owner").alias("query_id"), F.col("id").alias("landmark_id"), "d2")


def p2_recall(spark, sf_dir: str) -> DataFrame:
    """One row: how many pairs the exact answer has for the landmarks whose id is divisible by 100, whether the search finds at least nine tenths of them, and whether it finds any that is too far."""
    lm = _tables(spark, sf_dir)[1]
    key = ["owner", "row_no", "id"]
    near = similar_vectors(_hundredth(lm), lm).select(*key, "d2").withColumn("found", F.lit(True))
    exact = exact_vectors(_hundredth(lm), lm).select(*key)
    both = exact.withColumn("true", F.lit(True)).join(near, key, "full")
    return both.agg(F.count("true").alias("pairs"), (F.count_if(F.col("true") & F.col("found")) >= 0.9 * F.count("true")).alias("enough"), (F.count_if(F.col("d2") > 22500) > 0).alias("too_far"))


_SQL = """WITH l AS (SELECT id, list_transform(range(128), lambda i: CAST(CAST('0x' || substr(h, 1 + 2 * i, 2) AS INT) AS DOUBLE)) AS v FROM (SELECT DISTINCT id, hex("desc") AS h FROM landmarks WHERE id IS NOT NULL AND octet_length("desc") = 128)),
 p AS (SELECT q.id AS query_id, l.id AS landmark_id, list_distance(q.v, l.v) AS dist FROM l q, l WHERE q.id % 100 = 0 AND list_distance(q.v, l.v) <= 150),
 k AS (SELECT query_id, landmark_id, CAST(round(dist * dist) AS BIGINT) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, landmark_id) <= 8)"""
EXACT_SQL = _SQL + " SELECT * FROM k"
RECALL_SQL = _SQL + " SELECT count(*) AS pairs, true AS enough, false AS too_far FROM k"
