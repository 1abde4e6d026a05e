"""Consecutive numbers in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with 0, 1, 2 ... in the order of ``order``, whose ties must not matter.

    Rows are cut into ranges by sampling; each range is numbered within, after the sizes
    of those before it (one number a range). The columns of ``df`` stay.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("range__", F.spark_partition_id()), "ranges")
    sizes = {r["range__"]: r["n"] for r in placed.groupBy("range__").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    base, total = [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(total).cast("long")]
        total += sizes[p]
    before = F.element_at(F.create_map(*base), F.col("range__")) if base else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range__").orderBy(*order)) - 1
    return placed.select(*df.columns, (within + before).cast("long").alias(name))


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, dense): 0, 1, 2 ... in ascending id."""
    return numbered(ids.select("id"), "dense", F.col("id"))
