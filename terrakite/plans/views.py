"""Map-shaped views over the star-schema tables, with the same rows in Spark and in DuckDB.

They exercise the operators on tables that any SQL engine can read; geometry is synthetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrakite.plans.stage import table

#: name: (table, filter, select list); US(c) stands for microseconds since 1970.
_VIEWS = {
    "fx_landmarks": (
        "part",
        "true",
        """p_partkey AS id, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10 AS x, CAST(p_partkey * 11 % 100 AS DOUBLE) / 10 AS y, CAST(p_partkey * 53 % 1000 AS DOUBLE) / 10 AS z,
        CAST(p_size % 8 AS BIGINT) AS sightings, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10 - (1 + p_partkey % 5) AS lx, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10 + (1 + p_partkey % 5) AS ux,
        CAST(p_partkey * 53 % 1000 AS DOUBLE) / 10 - (1 + p_partkey % 5) AS lz, CAST(p_partkey * 53 % 1000 AS DOUBLE) / 10 + (1 + p_partkey % 5) AS uz""",
    ),
    "fx_frames": (
        "orders",
        "true",
        "o_orderkey AS frame_id, o_custkey % 50 AS session_id, US(o_orderdate) AS t, CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 10 AS cx, CAST(1.5 AS DOUBLE) AS cy, CAST(o_orderkey * 61 % 1000 AS DOUBLE) / 10 AS cz",
    ),
    "fx_observations": (
        "lineitem",
        "true",
        """l_partkey AS landmark_id, l_orderkey AS frame_id, l_linenumber AS seq, CAST((l_orderkey * 97 + l_partkey * 13) % 1920 AS DOUBLE) AS u, CAST((l_orderkey * 31 + l_partkey * 17) % 1440 AS DOUBLE) AS v,
        l_quantity / 5 AS size, l_discount AS response, CAST(l_linenumber - 1 + (l_partkey % 3 + 1) * 256 AS INT) AS octave, 1 + l_tax * 100 AS depth, l_suppkey % 3 AS conf_level""",
    ),
    "fx_positions": ("events", "event_type <> 'view'", "user_id % 10 AS session_id, event_id AS seq, US(ts) AS t, value AS x, CAST(event_id % 7 AS DOUBLE) AS y, CAST(event_id % 1000 AS DOUBLE) / 10 AS z"),
    "fx_locations": (
        "events",
        "event_type = 'view'",
        "user_id % 10 AS session_id, event_id AS seq, US(ts) AS t, 37 + CAST(event_id % 1000 AS DOUBLE) / 100000 AS lat, 139 + CAST(event_id * 7 % 1000 AS DOUBLE) / 100000 AS lon, value AS alt, CAST(5 + user_id % 10 AS DOUBLE) AS ha",
    ),
    "fx_measurements": ("events", "true", "user_id AS session_id, event_id AS seq, US(ts) AS t, value AS z, CAST(event_id % 101 AS DOUBLE) / 100 AS confidence"),
    "fx_anchors": ("nation", "true", "CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 7 % 25 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(n_nationkey * 11 % 25 AS DOUBLE) AS z, CAST(n_regionkey AS BIGINT) AS frame_id"),
    "fx_query_desc": ("embeddings", "vec_id % 10 = 0", "vec_id, embedding"),
    "fx_train_desc": ("embeddings", "vec_id % 10 <> 0", "vec_id, embedding"),
}
_EDGES = """SELECT src, dst FROM (
 SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst FROM {n} UNION ALL SELECT CAST((n_nationkey + 1) % 25 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {n}
 UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((7 * n_nationkey + 3) % 25 AS BIGINT) FROM {n} UNION ALL SELECT CAST((7 * n_nationkey + 3) % 25 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {n}) e WHERE src <> dst"""

#: The camera of every projection query.
FOCAL, CENTRE_X, CENTRE_Y = 1594.7247314453125, 952.8605346679688, 714.1676025390625


def _text(name: str, micros: str) -> str:
    import re

    source, where, columns = _VIEWS[name]
    return f"SELECT {re.sub(r'US\((\w+)\)', micros, columns)} FROM {source} WHERE {where}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    if name == "fx_edges":
        n = table(spark, sf_dir, "nation")
        return spark.sql(_EDGES.format(n="{n}"), n=n)
    source, where, columns = _VIEWS[name]
    micros = r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)"
    return spark.sql(f"SELECT {re.sub(r'US\((\w+)\)', micros, columns)} FROM {{t}} WHERE {where}", t=table(spark, sf_dir, source))


def with_views(sql: str) -> str:
    """`sql` with a common table for every view it names, for DuckDB."""
    found = [n for n in _VIEWS if n in sql]
    parts = [f"{n} AS ({_text(n, r'epoch_us(\1)')})" for n in found]
    if "fx_edges" in sql:
        parts.append(f"fx_edges AS ({_EDGES.format(n='nation')})")
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + (", " if parts else "") + rest[len("WITH RECURSIVE") :]
    if rest.upper().startswith("WITH"):
        return "WITH " + ",\n".join(parts) + (", " if parts else "") + rest[4:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + rest
