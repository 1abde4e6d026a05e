"""Degree statistics and validity checks; plain aggregates, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def degree_stats(graph: Graph) -> DataFrame:
    """One row: vertices, directed edges, mean, population deviation, extremes."""
    return graph.degrees().agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.coalesce(F.sum("deg"), F.lit(0)).alias("n_edges"),
        F.avg("deg").alias("avg_degree"),
        F.stddev_pop("deg").alias("std_degree"),
        F.min("deg").alias("min_degree"),
        F.max("deg").alias("max_degree"),
    )


def degree_extremes(graph: Graph) -> DataFrame:
    """One row: the vertices of largest and of smallest degree, the lowest id on ties."""
    key_high, key_low = F.struct(F.col("deg"), -F.col("id")), F.struct("deg", "id")
    return graph.degrees().agg(F.max_by("id", key_high).alias("max_id"), F.max("deg").alias("max_degree"), F.min_by("id", key_low).alias("min_id"), F.min("deg").alias("min_degree"))


def isolated(graph: Graph) -> DataFrame:
    """Vertices that no edge leaves or enters."""
    out = graph.vertices.join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti")
    return out.join(graph.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def lower_triangle(graph: Graph) -> DataFrame:
    """One row: whether every edge goes to a smaller id and none occurs twice."""
    counts = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    bad = counts.agg(F.coalesce(F.sum(F.when(F.col("dst") >= F.col("src"), F.col("n"))), F.lit(0)).alias("upward"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return bad.select("upward", "repeated", ((F.col("upward") == 0) & (F.col("repeated") == 0)).alias("is_lower_triangle"))


def symmetry(graph: Graph) -> DataFrame:
    """One row: edges without their reverse, loops, sum of degrees, whether vertex 0 is there."""
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = graph.edges.join(back, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("one_way"))
    loops = graph.edges.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"), F.count(F.lit(1)).alias("degree_sum"))
    zero = graph.vertices.agg(F.coalesce(F.max((F.col("id") == 0)), F.lit(False)).alias("has_zero"))
    return one_way.join(loops).join(zero)  # three rows of one


def graph_status(graph: Graph) -> DataFrame:
    """One row: sizes, degree statistics and extremes, isolated vertices, loops, one-way edges."""
    alone = isolated(graph).agg(F.count(F.lit(1)).alias("isolated"))
    checks = symmetry(graph).select("one_way", "loops", "has_zero")
    ends = degree_extremes(graph).select("max_id", "min_id")
    return degree_stats(graph).join(ends).join(alone).join(checks)  # rows of one
