"""References to records that do not exist: missing, deleted or late targets.

References and parents are shuffled on the key, sorted and merged in one linear pass (Spark's
sort-merge join; under adaptive execution a key with very many references is split across tasks).
Every parent carries its interval of validity, from its first arrival to its deletion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakite.plans.stage import first_delivery, table


def parents(df: DataFrame, key: str, arrived: str = "received_at", deleted: str = "deleted_at") -> DataFrame:
    """(target_key, valid_from, valid_to): one row per key, from its earliest arrival to its deletion (null: still there)."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("target_key")).agg(F.min(arrived).alias("valid_from"), F.max(deleted).alias("valid_to"))


def references(df: DataFrame, ref_table: str, key: str, target: str | Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ref_table, record_key, target_key, arrival, carried columns): one row per key of `df`, as first delivered."""
    target = F.col(target) if isinstance(target, str) else target
    rows = df.select(F.col(key).cast("long").alias("record_key"), target.cast("long").alias("target_key"), F.col("received_at").alias("arrival"), *carry)
    one = first_delivery(rows, "record_key", "target_key", *carry, arrival="arrival")
    return one.select(F.lit(ref_table).alias("ref_table"), "record_key", "target_key", "arrival", *carry)


def checked(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """`refs` with `state`: ok, missing (no such key), deleted (the target was withdrawn) or late (the target arrived after the record).

    A null or -1 target refers to nothing and is left out.  An unknown arrival on either side is
    never late.  `period` is the day of the record's arrival, null where unknown.
    """
    pointing = refs.where(F.col("target_key").isNotNull() & (F.col("target_key") != -1))
    both = pointing.hint("merge").join(targets.withColumn("_there", F.lit(True)), "target_key", "left")
    state = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("valid_to").isNotNull(), "deleted")
        .when(F.coalesce(F.col("valid_from") > F.col("arrival"), F.lit(False)), "late")
        .otherwise("ok")
    )
    return both.select("ref_table", "record_key", "target_key", state.alias("state"), F.date_format("arrival", "yyyy-MM-dd").alias("period"))


def checked_references(spark, sf_dir: str) -> DataFrame:
    """Every anchor, descriptor set and image that refers to a frame or image, with its state."""
    frames, images = table(spark, sf_dir, "frames"), table(spark, sf_dir, "images")
    frame_keys, image_keys = parents(frames, "id"), parents(images, "image_id")
    kept = references(images, "images", "image_id", F.col("image_id").cast("long") - 1, ("deleted_at",)).where("deleted_at IS NULL").drop("deleted_at")
    found = [
        checked(references(table(spark, sf_dir, "anchors"), "anchors", "id", "frame_id"), frame_keys),
        checked(references(table(spark, sf_dir, "descriptors"), "descriptors", "image_id", "image_id"), image_keys),
        checked(kept, frame_keys),
    ]
    return reduce(DataFrame.unionByName, found)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Records whose reference does not hold."""
    return checked_references(spark, sf_dir).where("state <> 'ok'").select("ref_table", "record_key", "target_key", "state", "period")


def p5_report(spark, sf_dir: str) -> DataFrame:
    """Per table and day of arrival: records that refer to something, and how many of them to what is missing, deleted or late."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return checked_references(spark, sf_dir).groupBy("ref_table", "period").agg(F.count("*").alias("checked"), n("missing"), n("deleted"), n("late"))


_SQL = """
WITH f AS (SELECT id AS k, min(received_at) AS va, max(deleted_at) AS del FROM frames WHERE id IS NOT NULL GROUP BY id),
i AS (SELECT CAST(image_id AS BIGINT) AS k, min(received_at) AS va, max(deleted_at) AS del FROM images WHERE image_id IS NOT NULL GROUP BY 1),
a AS (SELECT 'anchors' AS ref_table, id AS record_key, arg_min(frame_id, received_at) AS target_key, min(received_at) AS arrival FROM anchors WHERE id IS NOT NULL GROUP BY id),
d AS (SELECT 'descriptors' AS ref_table, CAST(image_id AS BIGINT) AS record_key, CAST(image_id AS BIGINT) AS target_key, min(received_at) AS arrival FROM descriptors WHERE image_id IS NOT NULL GROUP BY image_id),
m AS (SELECT 'images' AS ref_table, k AS record_key, k - 1 AS target_key, va AS arrival FROM i WHERE del IS NULL),
r AS (SELECT a.*, f.k, f.va, f.del FROM a LEFT JOIN f ON a.target_key = f.k
 UNION ALL SELECT d.*, i.k, i.va, i.del FROM d LEFT JOIN i ON d.target_key = i.k
 UNION ALL SELECT m.*, f.k, f.va, f.del FROM m LEFT JOIN f ON m.target_key = f.k),
c AS (SELECT ref_table, record_key, target_key, CASE WHEN k IS NULL THEN 'missing' WHEN del IS NOT NULL THEN 'deleted' WHEN va > arrival THEN 'late' ELSE 'ok' END AS state,
 strftime(arrival, '%Y-%m-%d') AS period FROM r WHERE target_key IS NOT NULL AND target_key <> -1)
"""
FOUND_SQL = _SQL + "SELECT * FROM c WHERE state <> 'ok'"
REPORT_SQL = _SQL + "SELECT ref_table, period, count(*) AS checked, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'late') AS late FROM c GROUP BY ref_table, period"
