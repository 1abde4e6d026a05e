"""Connected components by alternating star contractions, never on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release
from ..session import batches_of


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``edges``; ``root`` is the smallest node of its component.

    Each round contracts towards smaller neighbours and writes the edges to the
    shared folder; the number of rounds grows with the logarithm of the input. The
    smallest neighbour comes from a partial aggregate, so a node of very many edges
    is a skewed join at most, which adaptive execution splits. An empty table gives
    an empty table; loops and repeated edges change nothing.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    now = materialize(now, "edges")
    before = None
    while (after := _digest(now)) != before and after[0]:
        before = after
        # large star: the larger neighbours of a node move to its smallest neighbour or itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and itself, move to the smallest of them
        large = materialize(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "small-star")
        release(last, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each of ``n`` nodes' component under the pairs of positions."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above


def components_in_one(rows: DataFrame) -> DataFrame:
    """``components`` of the pairs (id, a) and (id, b) of each row, by one task that holds all rows; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            table = pa.Table.from_batches(some)
            node, place = np.unique(np.stack([table.column(c).to_numpy() for c in ("id", "a", "b")]), return_inverse=True)
            me, a, b = place.reshape(3, -1)
            root = node[roots(np.concatenate([me, me]), np.concatenate([a, b]), len(node))]
            yield from pa.table({"node": node, "root": root}).to_batches(max_chunksize=100_000)

    with batches_of(rows.sparkSession, 100_000):
        return materialize(rows.select("id", "a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "labels")
