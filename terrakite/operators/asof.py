"""Two-sided as-of joins with interpolation: both streams in one sorted pass, no join.

A session is cut into spans of time, so that a session with very many rows is many tasks.  A span
gets copies of the last sample before it and of the first two after it, which come from a small
table of the ends of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def lerp(t: Column, t0: Column, t1: Column, v0: Column, v1: Column) -> Column:
    """Linear between two instants; halfway if they are one."""
    share = F.when(t1 == t0, F.lit(0.5)).otherwise((t - t0).cast("double") / (t1 - t0).cast("double"))
    return share * (v1 - v0) + v0


def _span(c: str, width: int) -> Column:
    return F.expr(f"({c} div {width}L) - IF(({c} % {width}L) < 0, 1L, 0L)")


def _one_stream(samples: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """Samples (_s, _t, _q, _p) and asks (_s, _t, _o) as one stream of (_s, _k, _t, _side, _q, _p, _o), with border copies in every span that asks."""
    p = samples.withColumn("_k", _span("_t", width))
    o = asks.withColumn("_k", _span("_t", width))
    order = Window.partitionBy("_s", "_k").orderBy("_t", "_q")
    two = p.withColumn("_n", F.row_number().over(order)).where("_n <= 2").groupBy("_s", "_k").agg(F.sort_array(F.collect_list(F.struct("_n", "_t", "_q", "_p"))).alias("_two"))
    last = p.groupBy("_s", "_k").agg(F.max_by(F.struct("_t", "_q", "_p"), F.struct("_t", "_q")).alias("_last"))
    ends = two.join(last, ["_s", "_k"])
    spans = Window.partitionBy("_s").orderBy("_k")
    bare = lambda i: F.struct(F.get("_two", F.lit(i))["_t"].alias("_t"), F.get("_two", F.lit(i))["_q"].alias("_q"), F.get("_two", F.lit(i))["_p"].alias("_p"))
    pair = F.when(F.size("_two") > 1, F.array(bare(0), bare(1))).otherwise(F.array_compact(F.array(bare(0), F.lead(F.when(F.lit(True), bare(0))).over(spans))))
    ends = ends.select("_s", "_k", "_last", pair.alias("_pair"))
    all_spans = o.select("_s", "_k").distinct().withColumn("_asks", F.lit(True))
    known = ends.join(all_spans, ["_s", "_k"], "full")
    down = Window.partitionBy("_s").orderBy(F.desc("_k"))
    before = F.last("_last", ignorenulls=True).over(spans.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_pair", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    border = known.select("_s", "_k", "_asks", before.alias("_b"), after.alias("_a")).where("_asks")
    copies = border.select("_s", "_k", F.explode(F.concat(F.array_compact(F.array("_b")), F.coalesce("_a", F.array().cast(ends.schema["_pair"].dataType)))).alias("_c")).select("_s", "_k", "_c.*")
    none = F.lit(None).cast(o.schema["_o"].dataType)
    wanted = ["_s", "_k", "_t", "_side", "_q", "_p", "_o"]
    stream = p.unionByName(copies).withColumn("_side", F.lit(1)).withColumn("_o", none).select(*wanted)
    return stream.unionByName(o.select("_s", "_k", "_t", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_q"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), "_o"))


def _neighbours(stream: DataFrame) -> DataFrame:
    """(_o, _t, _prev, _next, _next2): the last sample before each ask, the first at or after it, and the one after that."""
    up = Window.partitionBy("_s", "_k").orderBy("_t", "_side", "_q")
    down = Window.partitionBy("_s", "_k").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_q"))
    so_far = lambda w, to: w.rowsBetween(Window.unboundedPreceding, to)
    follow = stream.withColumn("_f", F.when(F.col("_side") == 1, F.last("_p", ignorenulls=True).over(so_far(down, -1))))
    seen = follow.select(
        "_o", "_t", "_side", F.last("_p", ignorenulls=True).over(so_far(up, -1)).alias("_prev"), F.last("_p", ignorenulls=True).over(so_far(down, 0)).alias("_next"),
        F.last(F.when(F.col("_side") == 1, F.struct(F.col("_f").alias("p"))), ignorenulls=True).over(so_far(down, 0))["p"].alias("_next2"),
    )
    return seen.where("_side = 0")


def interpolate(positions: DataFrame, locations: DataFrame, session: str = "session_id", t: str = "t", seq: str = "seq", xyz: tuple[str, ...] = ("x", "y", "z"), width: int = HOUR_US) -> DataFrame:
    """Every location with the position at its time, from the last position before and the first at or after it.

    A location at the time of the session's first position uses the position after that one; with no
    position before it (or, then, none after), or none after it, it is left out.  Rows with a null
    session or time take no part; positions at one instant are ordered by `seq`.  Columns of
    `locations` are kept; `xyz` are added as rel_<name>.
    """
    ok = F.col(session).isNotNull() & F.col(t).isNotNull()
    p = positions.where(ok).select(F.col(session).alias("_s"), F.col(t).alias("_t"), F.col(seq).cast("long").alias("_q"), F.struct(F.col(t).alias("t"), *[F.col(c).cast("double").alias(c) for c in xyz]).alias("_p"))
    asks = locations.where(ok).select(F.col(session).alias("_s"), F.col(t).alias("_t"), F.struct(*locations.columns).alias("_o"))
    n = _neighbours(_one_stream(p, asks, width))
    at_first = F.col("_prev").isNull() & (F.col("_next.t") == F.col("_t"))
    a, b = F.when(at_first, F.col("_next")).otherwise(F.col("_prev")), F.when(at_first, F.col("_next2")).otherwise(F.col("_next"))
    found = n.select("_o", "_t", a.alias("_a"), b.alias("_b")).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return found.select("_o.*", *[lerp(F.col("_t"), F.col("_a.t"), F.col("_b.t"), F.col(f"_a.{c}"), F.col(f"_b.{c}")).alias(f"rel_{c}") for c in xyz])


def reinterpolate(observations: DataFrame, frames: DataFrame, session: str = "session_id", t: str = "t", frame_xyz: tuple[str, ...] = ("cx", "cy", "cz"), rel: tuple[str, ...] = ("rel_x", "rel_y", "rel_z"), frame_key: str = "frame_id", width: int = HOUR_US) -> DataFrame:
    """Observations with their relative position taken anew from the camera path.

    Between the last frame at or before and the first at or after: interpolated if they differ,
    else that frame; with a frame on one side only, that one; with none, the old position stays.  Of
    several frames at one instant the smallest key stands for them.
    """
    ok = F.col(session).isNotNull() & F.col(t).isNotNull()
    item = F.struct(F.col(t).alias("t"), *[F.col(c).cast("double").alias(c) for c in frame_xyz])
    p = frames.where(ok).groupBy(F.col(session).alias("_s"), F.col(t).alias("_t")).agg(F.min_by(item, F.col(frame_key)).alias("_p")).withColumn("_q", F.lit(0).cast("long"))
    rows = observations.select(F.col(session).alias("_s"), F.col(t).alias("_t"), F.struct(*observations.columns).alias("_o"))
    n = _neighbours(_one_stream(p, rows.where("_s IS NOT NULL AND _t IS NOT NULL"), width))
    exact = F.col("_next.t") == F.col("_t")
    both = F.col("_prev").isNotNull() & F.col("_next").isNotNull() & ~exact
    new = {
        r: F.when(F.coalesce(exact, F.lit(False)), F.col(f"_next.{c}"))
        .when(both, lerp(F.col("_t"), F.col("_prev.t"), F.col("_next.t"), F.col(f"_prev.{c}"), F.col(f"_next.{c}")))
        .otherwise(F.coalesce(F.col(f"_prev.{c}"), F.col(f"_next.{c}"), F.col(f"_o.{r}").cast("double")))
        for c, r in zip(frame_xyz, rel)
    }
    out = n.select(*[new[c].alias(c) if c in new else F.col(f"_o.{c}").alias(c) for c in observations.columns])
    return out.unionByName(rows.where("_s IS NULL OR _t IS NULL").select("_o.*"))
