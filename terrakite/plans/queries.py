"""Every query of the core: name -> callable(spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrakite.operators import near, orphans, spikes
from terrakite.plans import pose_queries, scene_queries, state_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": near.p1_found,
    "p3_found": spikes.p3_found,
    "p3_impossible": spikes.p3_impossible,
    "p3_stuck": spikes.p3_stuck,
    "p5_found": orphans.p5_found,
    "p5_report": orphans.p5_report,
} | state_queries.QUERIES | pose_queries.QUERIES | scene_queries.QUERIES

#: p1_found in SQL: an equi-join over cells of the radius; p3_found has no SQL form and is tested by brute force.
SQL: dict[str, str] = {
    "p1_found": near.FOUND_SQL,
    "p3_impossible": spikes.IMPOSSIBLE_SQL,
    "p3_stuck": spikes.STUCK_SQL,
    "p5_found": orphans.FOUND_SQL,
    "p5_report": orphans.REPORT_SQL,
} | state_queries.SQL | pose_queries.SQL | scene_queries.SQL
