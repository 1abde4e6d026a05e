"""Graphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst)``, one row for each direction of an edge.

    ``multigraph`` says that repeated edges are kept and count in degrees; nothing here
    removes them silently.
    """

    vertices: DataFrame
    edges: DataFrame
    multigraph: bool = False

    @classmethod
    def of_pairs(cls, pairs: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Simple graph of undirected pairs (a, b): loops and repeated pairs go, both directions come."""
        ends = pairs.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct()
        both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")
        ids = vertices if vertices is not None else both.select(F.col("src").alias("id")).distinct()
        return cls(ids, both)

    def degrees(self) -> DataFrame:
        """(id, deg) of all vertices; a loop and each repeated edge counts."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def stored(self, name: str = "graph") -> Graph:
        """The same graph, written once to the shared folder."""
        return Graph(materialize(self.vertices, f"{name}-vertices"), materialize(self.edges, f"{name}-edges"), self.multigraph)
