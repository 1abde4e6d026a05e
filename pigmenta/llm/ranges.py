"""Rows in an order as sorted runs, and their places in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .sketch import input_bytes

#: Bytes of a run as stored, about.
RUN_BYTES = 64 << 20
#: Most rows of the table of runs that are broadcast; a longer one is joined by shuffle.
BROADCAST_RUNS = 100_000
#: Places within a run take the low bits of ``monotonically_increasing_id``.
_RUN_BITS = 33


def placed(stored: DataFrame, group: str, *order: str) -> DataFrame:
    """``stored`` with ``at`` (0, 1, 2 ... within each value of ``group``) and ``n`` (rows of the group).

    ``stored`` is a table that can be read again and again, ``group`` has no nulls and leads the
    order; the order's ties must not matter. Rows are cut into ranges by sampling and each is
    sorted and written as a run, so a group of any size is spread over many tasks. The runs'
    rows are numbered as they stream; the places of the runs come from a table with one row for each run and group.
    """
    tasks = max(2 * stored.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(stored) // RUN_BYTES))
    keys = [group, *order]
    runs = materialize(stored.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("seq__", F.monotonically_increasing_id()), "runs")
    run = F.shiftright("seq__", _RUN_BITS).alias("run__")
    sizes = runs.groupBy(group, run).agg(F.min("seq__").alias("first__"), F.count(F.lit(1)).alias("size__"))
    earlier = Window.partitionBy(group).orderBy("run__")
    before = F.coalesce(F.sum("size__").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("size__").over(earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = materialize(sizes.select(group, "run__", "first__", before.alias("before__"), whole.alias("n")), "run-sizes")
    if table.count() <= BROADCAST_RUNS:
        table = F.broadcast(table)
    at = F.col("seq__") - F.col("first__") + F.col("before__")
    release(stored)
    return runs.withColumn("run__", run).join(table, [group, "run__"]).select(*stored.columns, at.cast("long").alias("at"), F.col("n").cast("long").alias("n"))
