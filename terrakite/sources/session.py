"""Session folders: frames.json, gps.json and map.json, and their tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakite.sources import schema


@dataclass(frozen=True)
class Session:
    """The tables of one capture and its map; `meta` has one row (origin_ready, origin)."""

    frames: DataFrame
    gps: DataFrame
    landmarks: DataFrame
    anchors: DataFrame
    edges: DataFrame
    meta: DataFrame

    def with_(self, **tables: DataFrame) -> "Session":
        return replace(self, **tables)


def file_prefix(frame_id: Column) -> Column:
    """The id in eight digits, or in all it has, and an underscore: the start of the names of a frame's pictures."""
    digits = frame_id.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0")), F.lit("_"))


def image_name(frame_id: Column) -> Column:
    """The name of a frame's image in models and their database."""
    return F.concat(file_prefix(frame_id), F.lit("image.jpeg"))


def decode_landmark(desc: Column) -> Column:
    """Base64 to exactly 128 bytes; anything else is an error, null stays null."""
    raw = F.unbase64(desc)
    ok = desc.isNull() | (F.length(raw) == schema.DESCRIPTOR_BYTES)
    return F.when(ok, raw).otherwise(F.raise_error(F.lit("a descriptor has to be 128 bytes")).cast("binary"))


def encode_landmark(desc: Column) -> Column:
    return F.base64(desc)


#: A file of this name in the folder of a document says that every element of its arrays has a line of its own, as write_session writes them.
_BY_LINE = "_one_element_a_line"


def _mark(spark: SparkSession, path: str):
    """(file system, path) of the mark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_BY_LINE}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """(value) the lines of a document without the commas between elements, or None if it is not known to have an element a line."""
    fs, mark = _mark(spark, path)
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "^,", "").alias("value")) if fs.exists(mark) else None


def _parsed(lines: DataFrame, fields: str) -> DataFrame:
    return lines.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def _json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    lines = _lines(spark, path)
    if lines is not None:
        return _parsed(lines.where(F.col("value").startswith("{")), fields)
    return spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_session(spark: SparkSession, folder: str, strict: bool = True) -> Session:
    """The tables of a folder.  `strict`: a landmark whose descriptor is not 128 bytes fails the query that reads it; else it gets null.

    Documents of write_session are read by many tasks, any other document by one.
    """
    frames, gps = _json(spark, f"{folder}/frames.json", schema.FRAMES), _json(spark, f"{folder}/gps.json", schema.GPS)
    lines = _lines(spark, f"{folder}/map.json")
    if lines is None:
        m = _json(spark, f"{folder}/map.json", schema.MAP_JSON)
        lm = m.select(F.explode("landmarks").alias("l")).select("l.*")
        pair = lambda c: m.select(F.explode(c).alias("p"))
    else:
        m = _parsed(lines.where(F.col("value").startswith('{"origin_ready"')).select(F.concat(F.expr(f"substring(value, 1, length(value) - {len(_LANDMARKS)})"), F.lit("}")).alias("value")), "origin_ready BOOLEAN, origin ARRAY<DOUBLE>")
        lm = _parsed(lines.where(F.col("value").startswith('{"id"')), schema.LANDMARK_JSON)
        of = {"anchors": r"^\[-?\d+,\{", "edges": r"^\[-?\d+,\["}
        pair = lambda c: lines.where(F.col("value").rlike(of[c])).select(F.from_json("value", "ARRAY<STRING>", {"mode": "FAILFAST"}).alias("p"))
    raw = F.unbase64("desc")
    desc = decode_landmark(F.col("desc")) if strict else F.when(F.length(raw) == schema.DESCRIPTOR_BYTES, raw)
    xyz = [F.get("position", F.lit(i)).alias(n) for i, n in enumerate("xyz")]
    landmarks = lm.select(
        "id", *xyz, "orientation", desc.alias("desc"), "sightings", F.col("bounds.lower.x").alias("lx"), F.col("bounds.lower.y").alias("lz"), F.col("bounds.upper.x").alias("ux"), F.col("bounds.upper.y").alias("uz"),
        F.lit(-1).cast("long").alias("last_seen"),
    )
    both = lambda df: df.select(F.get("p", F.lit(0)).cast("long").alias("id"), F.get("p", F.lit(1)).alias("v"))
    anchors = both(pair("anchors")).select("id", F.from_json("v", schema.ANCHOR_JSON).alias("a")).select("id", "a.frame_id", "a.transform", "a.relative_transform")
    edges = both(pair("edges")).select(F.col("id").alias("src"), F.explode(F.from_json("v", "ARRAY<BIGINT>")).alias("dst"))
    return Session(frames, gps, landmarks, anchors, edges, m.select("origin_ready", "origin"))


def landmark_structs(landmarks: DataFrame) -> DataFrame:
    """Landmarks in the shape of the map file."""
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    bounds = F.struct(corner("lx", "lz").alias("lower"), corner("ux", "uz").alias("upper"))
    return landmarks.select("id", encode_landmark(F.col("desc")).alias("desc"), F.array("x", "y", "z").alias("position"), "orientation", F.col("sightings").cast("int").alias("sightings"), bounds.alias("bounds"))


_LANDMARKS = ',"landmarks":['


def _elements(df: DataFrame, text: Column) -> DataFrame:
    """(value): the JSON `text` of every row, a line each, as the elements of an array: all but the first begin with a comma.

    The first is one of those with the smallest hash; the others stay where they are, so that no task holds the table.
    """
    spark, h = df.sparkSession, F.xxhash64(*df.columns)
    least = df.agg(F.min(h)).first()[0]
    if least is None:
        return spark.createDataFrame([], "value string")
    few = df.where(h == least).groupBy(text.alias("j")).count().orderBy("j").first()
    copies = spark.range(few["count"]).select(F.concat(F.when(F.col("id") > 0, ",").otherwise(""), F.lit(few["j"])).alias("value"))
    others = df.where((h != least) | (text != few["j"])).select(F.concat(F.lit(","), text).alias("value"))
    return copies.unionAll(others)


def _row_text(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _in_order(spark: SparkSession, *parts: DataFrame | str) -> DataFrame:
    """(value): the lines of a document, its parts one after the other; a text is a line."""
    tables = [spark.range(1, numPartitions=1).select(F.lit(p).alias("value")) if isinstance(p, str) else p for p in parts]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _array_document(df: DataFrame) -> DataFrame:
    return _in_order(df.sparkSession, "[", _elements(df, _row_text(*df.columns)), "]")


def map_document(s: Session) -> DataFrame:
    """(value): the lines of the map file in order, one for each landmark, anchor and list of edges."""
    keyed = lambda v: F.concat(F.lit("["), "id", F.lit(","), v, F.lit("]"))
    adjacency = s.edges.where("src IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("d"))
    anchors = s.anchors.where("id IS NOT NULL").select("id", "frame_id", "transform", "relative_transform")
    head = s.meta.select(_row_text("origin_ready", "origin").alias("h")).select(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(_LANDMARKS)).alias("value"))
    lm = landmark_structs(s.landmarks)
    parts = _elements(lm, _row_text(*lm.columns)), _elements(anchors, keyed(_row_text(*anchors.columns))), _elements(adjacency, keyed(F.to_json("d")))
    return _in_order(s.meta.sparkSession, head, parts[0], '],"anchors":[', parts[1], '],"edges":[', parts[2], "]}")


def _write_document(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").text(path)
    fs, mark = _mark(lines.sparkSession, path)
    fs.create(mark).close()


def write_session(s: Session, folder: str) -> None:
    """frames.json, gps.json and map.json, each a folder of compressed text parts that together, in order of their names, are the one document; read_session reads them by line."""
    _write_document(_array_document(s.frames.select("id", "timestamp", "intrinsics", "extrinsics")), f"{folder}/frames.json")
    _write_document(_array_document(s.gps.select("timestamp", "relative", "global", "accuracy")), f"{folder}/gps.json")
    _write_document(map_document(s), f"{folder}/map.json")


_TABLES = ("frames", "gps", "landmarks", "anchors", "edges", "meta")


def write_tables(s: Session, folder: str) -> None:
    """The canonical form at any size: a Parquet table each."""
    for name in _TABLES:
        getattr(s, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str) -> Session:
    return Session(**{n: spark.read.parquet(f"{folder}/{n}.parquet") for n in _TABLES})


def add_frame(frames: DataFrame, timestamp: int, intrinsics: list[float], extrinsics: list[float]) -> DataFrame:
    """`frames` with one more, whose id is the number of frames before it."""
    new = frames.agg(F.count("*").alias("id")).select("id", F.lit(timestamp).cast("long").alias("timestamp"), F.array(*map(F.lit, map(float, intrinsics))).alias("intrinsics"), F.array(*map(F.lit, map(float, extrinsics))).alias("extrinsics"))
    return frames.select("id", "timestamp", "intrinsics", "extrinsics").unionByName(new)
