"""Records of two tables paired with the nearest in time of the same entity, within a tolerance.

Time is cut into spans much longer than the tolerance; an event also goes to the neighbouring span
it can reach into.  Spans of entities are hash-partitioned into Arrow groups, and in each group
DuckDB looks backward and forward with ASOF joins; the nearer candidate wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakite.plans.stage import arrow_groups

SPAN_TOLERANCES = 100
GROUP_ROWS = 150_000

_ASOF = """
WITH r AS (SELECT DISTINCT entity, span, t, k FROM {l} WHERE probe),
e AS (SELECT entity, span, t, min(k) AS k FROM {l} WHERE NOT probe GROUP BY ALL),
b AS (SELECT r.entity, r.span, r.t, r.k, e.k AS ek, e.t AS et FROM r ASOF LEFT JOIN e ON r.entity = e.entity AND r.span = e.span AND r.t >= e.t),
f AS (SELECT r.entity, r.span, r.t, r.k, e.k AS ek, e.t AS et FROM r ASOF LEFT JOIN e ON r.entity = e.entity AND r.span = e.span AND r.t <= e.t),
c AS (SELECT b.k, b.t - b.et AS back, b.ek AS bk, f.et - f.t AS ahead, f.ek AS fk FROM b JOIN f USING (entity, span, t, k))
SELECT k AS left_key, CASE WHEN near_back THEN bk ELSE fk END AS right_key, CASE WHEN near_back THEN back ELSE ahead END AS apart
FROM (SELECT *, coalesce(back <= {tol}, false) AND (ahead IS NULL OR back <= ahead) AS near_back FROM c)
WHERE near_back OR coalesce(ahead <= {tol}, false)
"""


def _pair(tolerance: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect(config={"threads": "1", "memory_limit": "600MB"})
        try:
            con.register("rows_", t)
            return con.sql(_ASOF.format(l="rows_", tol=tolerance)).to_arrow_table()
        finally:
            con.close()

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, span_tolerances: int = SPAN_TOLERANCES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(left_key, right_key, apart): every left record with the nearest right record of its entity.

    Both sides: (key bigint, entity bigint, t bigint).  Pairs at most `tolerance` apart; at equal
    distance the earlier right record, then the smaller key.  Rows with a null key, entity or time
    take no part; copies of a row change nothing.  A left key delivered with several times (or
    entities) is paired at its nearest.  Right records of one entity at one instant are reduced to the
    smallest key before the shuffle; an entity with very many records is spread over its spans.
    """
    span = max(1, tolerance) * span_tolerances
    ok = "key IS NOT NULL AND entity IS NOT NULL AND t IS NOT NULL"
    at = lambda c: F.expr(f"(({c}) div {span}L) - IF((({c}) % {span}L) < 0, 1L, 0L)")  # noqa: E731  (floor division, exact for any 64-bit time)
    probe = left.where(ok).select("entity", at("t").alias("span"), "t", F.col("key").alias("k"), F.lit(True).alias("probe"))
    one = right.where(ok).groupBy("entity", "t").agg(F.min("key").alias("k"))
    reach = F.array_distinct(F.array_compact(F.array(at(f"try_subtract(t, {tolerance}L)"), at("t"), at(f"try_add(t, {tolerance}L)"))))
    event = one.select("entity", F.explode(reach).alias("span"), "t", "k", F.lit(False).alias("probe"))
    groups = arrow_groups(left.sparkSession, right.count() + left.count(), group_rows)
    keyed = probe.unionByName(event).withColumn("_part", F.pmod(F.xxhash64("entity", "span"), F.lit(groups)))
    found = keyed.groupBy("_part").applyInArrow(_pair(tolerance), "left_key bigint, right_key bigint, apart bigint")
    return found.groupBy("left_key").agg(F.min_by(F.struct("right_key", "apart"), F.struct("apart", "right_key")).alias("p")).select("left_key", "p.right_key", "p.apart")


TOLERANCE_US = 1_200_000


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Every frame with the nearest fix of its session, at most 1.2 s away."""
    from terrakite.plans.stage import table

    side = lambda name, key: table(spark, sf_dir, name).where("`timestamp` > 0").select(F.col(key).cast("long").alias("key"), F.col("session_id").cast("long").alias("entity"), F.col("timestamp").cast("long").alias("t"))
    r = nearest_in_time(side("frames", "id"), side("gps", "gps_id"), TOLERANCE_US)
    return r.select(F.col("left_key").alias("frame_id"), F.col("right_key").alias("gps_id"))


FOUND_SQL = """
WITH f AS (SELECT DISTINCT id AS frame_id, session_id, "timestamp" AS t FROM frames WHERE "timestamp" > 0 AND session_id IS NOT NULL AND id IS NOT NULL),
g AS (SELECT session_id, "timestamp" AS t, min(gps_id) AS gps_id FROM gps WHERE "timestamp" > 0 AND session_id IS NOT NULL AND gps_id IS NOT NULL GROUP BY ALL),
j AS (SELECT f.frame_id, g.gps_id, abs(f.t - g.t) AS d, g.t FROM f JOIN g ON f.session_id = g.session_id AND g.t BETWEEN f.t - 1200000 AND f.t + 1200000)
SELECT frame_id, gps_id FROM j QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY d, t, gps_id) = 1
"""
