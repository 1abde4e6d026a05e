"""Groups of whole connected components, each of which one task can hold.

What happens in one component does not depend on another, save for numbers of the whole graph
such as a peeling threshold. So a kernel (``local``) over a group of whole components gives
what it gives over the whole graph, in one job, however large the graph is. A graph with a component
that no task can hold has no such groups: it is for the rounds between buckets (``resident``).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import materialize, release
from . import local
from .components import components, components_in_one
from .disk import LOCAL_VERTICES
from .local import Csr, peel_local
from .peel import RULES, Left
from .resident import BUCKET_EDGES, bucketed

#: Runs in which the thresholds of all groups must come to agree; beyond them, rounds are as good.
MOST_PASSES = 20
_KINDS = {"int": "int32", "long": "int64", "double": "float64"}


def _csr(table: pa.Table) -> Csr:
    ids, near = table.column("id").combine_chunks(), table.column("near").combine_chunks()
    ids = ids.to_numpy(zero_copy_only=False)
    counts = np.asarray(pc.list_value_length(near))
    return Csr(ids, np.repeat(ids, counts), near.flatten().to_numpy(zero_copy_only=False))


@dataclass(frozen=True)
class Pieces:
    """The table ``name``: (group, id, near) with the neighbours of each vertex; a group is whole components."""

    spark: SparkSession
    name: str

    def run(self, kernel: Callable[[Csr], pd.DataFrame], ddl: str) -> DataFrame:
        """What ``kernel`` makes of each group, one task at a time holding one group."""

        kinds = {name: _KINDS[kind] for name, kind in (column.split() for column in ddl.split(", "))}

        def work(table: pa.Table) -> pa.Table:
            return pa.Table.from_pandas(kernel(_csr(table)).astype(kinds), preserve_index=False)

        return self.spark.table(self.name).groupBy("group").applyInArrow(work, ddl)

    def stored(self, kernel: Callable[[Csr], pd.DataFrame], ddl: str) -> DataFrame:
        """``run``, written; the table of groups goes."""
        return self._written(self.run(kernel, ddl))

    def stored_with(self, rows: DataFrame, kernel: Callable[[Csr, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
        """``stored``, of a kernel that also gets its group's ``rows`` (one a vertex) in ascending id."""
        kinds = {name: _KINDS[kind] for name, kind in (column.split() for column in ddl.split(", "))}

        def work(table: pa.Table, rows: pa.Table) -> pa.Table:
            beside = rows.drop_columns(["home"]).sort_by("id").to_pandas()
            return pa.Table.from_pandas(kernel(_csr(table), beside).astype(kinds), preserve_index=False)

        placed = rows.join(self.spark.table(self.name).select("id", F.col("group").alias("home")), "id")
        return self._written(self.spark.table(self.name).groupBy("group").cogroup(placed.groupBy("home")).applyInArrow(work, ddl))

    def _written(self, df: DataFrame) -> DataFrame:
        found = materialize(df, "pieces-result")
        self.drop()
        return found

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def labels(adjacency: DataFrame, first: DataFrame) -> DataFrame:
    """(id, piece) of every vertex of (id, near); ``piece`` is a vertex of its component.

    ``first`` has the labels (node, root) by the least and the largest neighbour of each vertex, which join nearly all of a
    component, and are two pairs a vertex. Then all edges are looked at once for those between two labels.
    """
    left, right = first.withColumnsRenamed({"node": "id", "root": "a"}), first.withColumnsRenamed({"node": "other", "root": "b"})
    edges = adjacency.join(left, "id").select("a", F.explode(F.filter("near", lambda x: x > F.col("id"))).alias("other"))
    cross = materialize(edges.join(right, "other").where("a != b").select("a", "b").distinct(), "cross")
    if cross.head(1):
        roots = components(cross, "a", "b").withColumnsRenamed({"node": "root", "root": "top"})
        first = materialize(first.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    return adjacency.select("id").join(first.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("piece"))


def pieces(graph: Graph, most: int | None = None) -> Pieces | None:
    """The graph in groups of some ``BUCKET_EDGES`` vertices and edges; None if a component has more than ``most`` (``LOCAL_EDGES``).

    Larger components are groups of their own, small ones share groups by hash.
    """
    most = most or local.LOCAL_EDGES
    target = min(BUCKET_EDGES, most)
    spark = graph.vertices.sparkSession
    ends = materialize(graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b")), "ends")
    if ends.count() <= LOCAL_VERTICES:
        first = components_in_one(ends)
    else:
        first = materialize(components(ends.select("id", F.explode(F.array("a", "b")).alias("other")), "id", "other"), "labels")
    sums = ends.join(first, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id")).agg(F.sum(F.col("n") + 1).alias("size"), F.max("n").alias("n"))
    row = sums.agg(F.max("size").alias("size"), F.max("n").alias("n")).first()
    release(ends)
    if (row["n"] or 0) >= most or (row["size"] or 0) > most:  # what is joined so far is within a component
        release(first)
        return None
    near = graph.edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"))
    none = F.array().cast("array<long>")
    adjacency = materialize(graph.vertices.select("id").distinct().join(near, "id", "left").select("id", F.coalesce("near", none).alias("near")), "adjacency")
    labelled = materialize(adjacency.select("id", F.size("near").alias("n")).join(labels(adjacency, first), "id"), "labelled")
    sizes = materialize(labelled.groupBy("piece").agg(F.sum(F.col("n") + 1).alias("size")), "sizes")
    row = sizes.agg(F.max("size").alias("largest"), F.sum("size").alias("all"), F.sum(F.when(F.col("size") * 8 <= target, F.col("size"))).alias("small")).first()
    if (row["largest"] or 0) > most:
        release(adjacency, labelled, sizes)
        return None
    shared = max(1, -(-int(row["small"] or 0) // target))
    group = F.when(F.col("size") * 8 <= target, F.pmod(F.xxhash64("piece"), F.lit(shared)) * 2).otherwise(F.col("piece") * 2 + 1)
    where = labelled.join(sizes.select("piece", group.alias("group")), "piece").select("id", "group")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(row["all"] or 0) // target))
    name = bucketed(adjacency.join(where, "id").select("group", "id", "near"), buckets, "group", "pieces")
    release(adjacency, labelled, sizes)
    return Pieces(spark, name)


def thresholds(found: Pieces, rule: str, theta: int) -> list[float] | None:
    """The thresholds of all rounds of a peeling rule over the whole graph; None if the groups do not come to agree.

    Each group runs by the thresholds it would have alone, and says how many vertices, which sum and which
    least degrees it had before each round. The numbers of all groups together give the thresholds of
    the whole graph, right up to the first round in which a group took another one. Then groups run by those,
    and so on until all had the right ones: each run settles a round at least.
    """
    kind, bases = RULES[rule], []
    if kind.strict and not (kind.margin and theta):
        return _merged(found, rule, theta)
    for _ in range(MOST_PASSES):

        def profile(g: Csr, bases: list[float] = bases) -> pd.DataFrame:
            seen: list[tuple] = []
            peel_local(g, rule, theta, bases, seen)
            return pd.DataFrame(seen, columns=["round", "n", "total", "least", "before", "base"]).astype({"base": float})

        rows = found.run(profile, "round long, n long, total long, least long, before long, base double").groupBy("round").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.min("before").alias("before"), F.min("base").alias("low"), F.max("base").alias("high")
        )
        rows = rows.orderBy("round").collect()  # one row a round
        bases = [float(kind.base(r["round"], Left(r["n"], r["total"], r["least"], r["before"]), theta)) for r in rows]
        if all(r["low"] == r["high"] == base for r, base in zip(rows, bases)):
            return bases
    return None


def _merged(found: Pieces, rule: str, theta: int) -> list[float]:
    """The thresholds of a strict rule without a margin, from one run of the groups, however unlike they are.

    The least degree of all is that of some groups. Those lose just the vertices they would lose on their own, and the
    others lose none. So a group's least degrees follow each other as they do alone, and only when each has its
    turn depends on the others: always the groups with the least one. The driver gets a number a round of each group.
    """

    def profile(g: Csr) -> pd.DataFrame:
        seen: list[tuple] = []
        peel_local(g, rule, theta, seen=seen)
        return pd.DataFrame({"first": [g.ids[0]] * len(seen), "round": [s[0] for s in seen], "least": [s[3] for s in seen]})

    rows = found.run(profile, "first long, round long, least long").toPandas().sort_values(["first", "round"])
    turns = [of["least"].tolist() for _, of in rows.groupby("first")]
    waiting = [(least[0], i, 0) for i, least in enumerate(turns)]
    heapq.heapify(waiting)
    bases: list[float] = []
    while waiting:
        now, next_ = waiting[0][0], []
        bases.append(float(now))
        while waiting and waiting[0][0] == now:
            _, i, at = heapq.heappop(waiting)
            if at + 1 < len(turns[i]):
                next_.append((turns[i][at + 1], i, at + 1))
        for turn in next_:
            heapq.heappush(waiting, turn)
    return bases
