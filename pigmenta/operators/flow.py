"""Residual graphs, maximum flow and reachability of flow problems.

The residual graph and reachability are distributed. Push and relabel is sequential and
runs on graphs that one task can hold, which is counted first.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from ..sources.files import FlowProblem

_MAX_EDGES = 2_000_000


def residual(edges: DataFrame) -> DataFrame:
    """(src, dst, residual, back): room of each pair of vertices, and that of the way back.

    Capacities of parallel arcs add up, loops go; an arc without a reverse gets one
    of no room.
    """
    room = edges.where("src != dst").groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(0)).cast("long")).alias("residual"))
    back = room.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("residual").alias("back"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return room.join(back, ["src", "dst"], "full").select("src", "dst", zero("residual"), zero("back"))


def describe(problem: FlowProblem) -> DataFrame:
    """(id, kind, out_room, in_room, arcs): each vertex of a problem with its room, for printing."""
    arcs = residual(problem.graph.edges)
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("residual").alias("out_room"), F.sum("back").alias("in_room"), F.count(F.lit(1)).alias("arcs"))
    kind = F.when(F.col("id") == problem.source, "source").when(F.col("id") == problem.sink, "sink").otherwise("inner")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return problem.graph.vertices.join(out, "id", "left").select("id", kind.alias("kind"), zero("out_room"), zero("in_room"), zero("arcs"))


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """(id) that edges (src, dst) reach from ``start``, itself included."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start,)], "id long")
    frontier = seen
    while True:
        near = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(near.join(seen, "id", "left_anti"), "frontier")
        if not frontier.head(1):
            return seen
        seen = materialize(seen.unionByName(frontier), "seen")


def _push_relabel(n: int, src: np.ndarray, dst: np.ndarray, capacity: np.ndarray, source: int, sink: int) -> int:
    """The flow into the sink; vertices with excess wait in a queue."""
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for u, v, c in zip(src.tolist(), dst.tolist(), capacity.tolist()):
        if u != v:
            room[u][v] = room[u].get(v, 0) + c
            room[v].setdefault(u, 0)
    height, excess = [0] * n, [0] * n
    height[source] = n
    queue: deque[int] = deque()
    for v, c in list(room[source].items()):
        if c:
            room[source][v], room[v][source] = 0, room[v][source] + c
            excess[v] += c
            if v != sink:
                queue.append(v)
    while queue:
        u = queue.popleft()
        if u in (source, sink):
            continue
        while excess[u]:
            lowest = None
            for v, c in room[u].items():
                if c and height[u] == height[v] + 1:
                    moved = min(excess[u], c)
                    room[u][v] -= moved
                    room[v][u] += moved
                    excess[u] -= moved
                    if not excess[v] and v not in (source, sink):
                        queue.append(v)
                    excess[v] += moved
                    if not excess[u]:
                        break
                elif c:
                    lowest = height[v] if lowest is None else min(lowest, height[v])
            else:
                if excess[u]:
                    lowest = min((height[v] for v, c in room[u].items() if c), default=None)
                    if lowest is None:
                        break
                    height[u] = lowest + 1
    return excess[sink]


def max_flow(problem: FlowProblem) -> DataFrame:
    """One row: the flow from the source to the sink, and whether there is any path."""
    edges = problem.graph.edges.select("src", "dst", "weight").where("weight > 0")
    if edges.limit(_MAX_EDGES + 1).count() > _MAX_EDGES:
        raise ValueError(f"more than {_MAX_EDGES} arcs: push and relabel is sequential")
    n = problem.graph.vertices.agg(F.max("id")).first()[0] + 1
    source, sink = problem.source, problem.sink  # the problem itself holds a session

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flow = _push_relabel(n, pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), source, sink)
        return pd.DataFrame({"max_flow": [flow]})

    found = edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf), "max_flow long")
    path = reachable(edges, source).where(F.col("id") == sink).agg((F.count(F.lit(1)) > 0).alias("has_path"))
    return path.join(found, how="left").select(F.coalesce("max_flow", F.lit(0)).alias("max_flow"), "has_path")
