"""Checks and reports of colourings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


def verify(graph: Graph, colors: DataFrame, loops_conflict: bool = False) -> DataFrame:
    """One row: vertices, uncoloured ones, conflicting edges, colours used (largest colour + 1)."""
    own = graph.vertices.join(colors, "id", "left").agg(F.count(F.lit(1)).alias("n_vertices"), F.count(F.when(F.col("color").isNull() | (F.col("color") < 0), 1)).alias("uncolored"), (F.coalesce(F.max("color"), F.lit(-1)) + 1).cast("long").alias("colors_used"))
    edges = graph.edges if loops_conflict else graph.edges.where("src != dst")
    left, right = colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), colors.select(F.col("id").alias("dst"), F.col("color").alias("c2"))
    bad = edges.join(left, "src").join(right, "dst").where("c1 = c2").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count(F.lit(1)).alias("conflicts"))
    return own.join(bad)  # one row each


def histogram(colors: DataFrame, classes: int | None = 16) -> DataFrame:
    """(color, n, cumulative_percent) of the first classes; the window runs over classes, not vertices."""
    counts = colors.groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    upto, every = Window.orderBy("color").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    shares = counts.withColumn("cumulative_percent", 100.0 * F.sum("n").over(upto) / F.sum("n").over(every))
    return shares if classes is None else shares.where(F.col("color") < classes)


def throughput(n_vertices: int, n_edges: int, seconds: float) -> dict[str, float]:
    """Millions of vertices and of edges a second."""
    return {"mnodes_per_s": n_vertices / seconds / 1e6, "medges_per_s": n_edges / seconds / 1e6}
