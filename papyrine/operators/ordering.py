"""Positions in a global order without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_position(df: DataFrame, by: str, name: str = "position") -> DataFrame:
    """1-based positions by a unique column: rows are range-partitioned, counted per range, and numbered inside it."""
    ranged = df.repartitionByRange(by).withColumn("_range", F.spark_partition_id())
    from papyrine.scratch import materialize

    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")
