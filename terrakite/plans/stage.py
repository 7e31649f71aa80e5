"""Sessions, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrakite")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a Spark context, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_terrakite_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="terrakite-ship-"), "terrakite.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("terrakite", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._terrakite_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where a test session names none, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), f"terrakite-{os.getpid()}")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def _remove_written() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; then whoever owns the folder clears it
            pass


atexit.register(_remove_written)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Cuts the lineage with a copy that outlives any executor, so that a result used by several
    later steps is computed once.  Written tables go when they are discarded or the driver ends.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/terrakite-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._terrakite_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of staged tables that nothing reads any more, as loops do with the round before.  Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_terrakite_path", None)
        if path and (df.sparkSession, path) in _written:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            _written.remove((df.sparkSession, path))


def first_delivery(df: DataFrame, key: str, *columns: str, arrival: str = "received_at") -> DataFrame:
    """One row per `key`: its `columns` as first delivered, and `arrival` as its earliest.

    Rows without a key are dropped: they name nothing.  A row without an arrival counts as the
    last.  Deliveries at the same instant are taken to be equal, as copies are; should they differ,
    each column is that of one of them.  Hash aggregation combines before the shuffle, so a key with
    a third of all rows costs no more than another.
    """
    last = F.lit("9999-12-31 00:00:00").cast(df.schema[arrival].dataType)
    order = F.coalesce(F.col(arrival), last)
    one = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key))
    return one.agg(F.min(arrival).alias(arrival), *[F.min_by(F.col(f"`{c}`"), order).alias(c) for c in columns])


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """`df` with a column `name`: 1, 2, 3 ... in the order given (columns or expressions, which should leave no ties).

    Rows are cut into ranges of the order and numbered inside a range, with the counts of the ranges
    before it added, so no task sorts them all.
    """
    keys = {f"_k{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    cut = staged(df.withColumns(keys).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(ends), F.lit(0))).drop("_c")
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return cut.withColumn("_inside", n).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_part", *keys)


def arrow_groups(spark: SparkSession, rows: int, per_group: int) -> int:
    """How many Arrow groups of about `per_group` rows hold `rows`, at least one a core."""
    return max(1, spark.sparkContext.defaultParallelism, -(-rows // per_group))
