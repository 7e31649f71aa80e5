"""Long ordered groups cut into chunks of bounded size, each with a few rows of its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_chunks(rows: DataFrame, group: str, order: str, size: int = 8192, halo: int = 512, bin_width: int = 1024, counted: DataFrame | None = None) -> DataFrame:
    """`rows` with `_chunk` and `_own`: rows of a group in order of the integer `order`, cut every `size` or so.

    A chunk also gets at least `halo` rows of the chunk before and after it (`_own` false),
    as far as there are any.  Positions come from counts of bins of `bin_width` values of `order`: the
    rows of a group never meet in one task, only its counts do, one a bin (as many as rows where a group's
    values lie that far apart).  Values of
    `order` identify a row in its group; copies of one count once.  Needs halo + bin_width <= size.
    `counted`: the same groups and orders from a cheaper plan, for the counting pass.
    """
    b = F.floor(F.col(order) / bin_width)
    keyed = rows.withColumn("_bin", b)
    counted = (rows if counted is None else counted).withColumn("_bin", b).groupBy(group, "_bin").agg(F.least(F.count("*"), F.lit(bin_width)).alias("n"))
    w = Window.partitionBy(group).orderBy("_bin")
    at = counted.withColumn("end", F.sum("n").over(w)).withColumn("begin", F.col("end") - F.col("n")).withColumn("c", F.floor(F.col("begin") / size))
    cw = Window.partitionBy(group, "c")
    at = at.withColumn("c0", F.min("begin").over(cw)).withColumn("c1", F.max("end").over(cw)).withColumn("last", F.max("c").over(Window.partitionBy(group)))
    before = F.when((F.col("c") > 0) & (F.col("begin") < F.col("c0") + halo), F.col("c") - 1)
    after = F.when((F.col("c") < F.col("last")) & (F.col("end") > F.col("c1") - halo), F.col("c") + 1)
    to = at.select(F.col(group).alias("_g"), F.col("_bin").alias("_b"), "c", F.array_compact(F.array(F.col("c"), before, after)).alias("to"))
    joined = keyed.join(to, (F.col(group) == F.col("_g")) & (F.col("_bin") == F.col("_b")))
    return joined.withColumn("_chunk", F.explode("to")).withColumn("_own", F.col("_chunk") == F.col("c")).drop("_bin", "_g", "_b", "c", "to")
