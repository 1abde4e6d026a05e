"""Partitions of a graph, their boundary, and colouring part by part around it."""

from __future__ import annotations

import os
import resource
import socket
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import LARGE_DEGREE, int_hash, is_large
from ..graph import Graph
from ..scratch import materialize, release, scratch_path
from . import local
from .coloring import color_rounds
from .local import LOCAL_EDGES, Csr, first_fit, greedy_on, greedy_partition, hash32, in_one, peel_local
from .multilevel import multilevel
from .numbering import numbered
from .peel import peel

METHODS = ("round_robin", "random", "ldg", "lp", "multilevel")
_ALIASES = {"rr": "round_robin", "rand": "random", "metis": "multilevel", "kahip": "multilevel", "mt_kahip": "multilevel", "mtkahip": "multilevel"}


def parse_method(name: str) -> str:
    """Partitioner by name, in any case. The names of external partitioners mean the multilevel one here."""
    key = name.lower()
    key = _ALIASES.get(key, key)
    if key not in METHODS:
        raise ValueError(f"unknown partitioner: {name}")
    return key


def round_robin(graph: Graph, parts: int) -> DataFrame:
    return graph.vertices.select("id", F.pmod("id", F.lit(parts)).cast("int").alias("part"))


def random_parts(graph: Graph, parts: int) -> DataFrame:
    """Parts of equal size, give or take one (the first ones are larger), in the order of the ids' hashes."""
    rows = numbered(graph.vertices.select("id"), "at", int_hash(F.col("id")), F.col("id"))
    size, larger = divmod(rows.count(), parts)
    first = F.col("at") < larger * (size + 1)
    part = F.when(first, F.floor(F.col("at") / (size + 1))).otherwise(larger + F.floor((F.col("at") - larger * (size + 1)) / max(size, 1)))
    return rows.select("id", part.cast("int").alias("part"))


def ldg(graph: Graph, parts: int) -> DataFrame:
    """One greedy pass over the vertices in id order.

    It is sequential by definition, so tasks follow each other: each takes the next range of ids, of ``LOCAL_EDGES``
    vertices and edges at most, with the parts of neighbours in ranges before and the sizes of the parts so far.
    """
    if local.fits(graph):
        return in_one(graph, lambda g: pd.DataFrame({"id": g.ids, "part": greedy_partition(g, parts).astype(np.int32)}), "id long, part int")
    most = local.LOCAL_EDGES
    if (graph.edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0) >= most:
        raise local.too_large("the greedy partition of one vertex's neighbours")
    near = graph.edges.where("dst < src").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"))
    ids = numbered(graph.vertices.select("id").distinct(), "at", F.col("id"))
    n = ids.count()
    block = F.floor(F.col("at") / max(1, n // _BLOCKS)).alias("block")
    rows = materialize(ids.join(near, "id", "left").select("id", block, F.coalesce("near", F.array().cast("array<long>")).alias("near")), "ldg-rows")
    sizes = rows.groupBy("block").agg(F.sum(F.size("near") + 1).alias("size"), F.max("id").alias("last")).orderBy("block").collect()  # one row a block of ids
    ends, size = [], 0
    for at, r in enumerate(sizes):
        if size and size + r["size"] > most:
            ends.append(sizes[at - 1]["last"])
            size = 0
        size += r["size"]
    ends.append(sizes[-1]["last"])
    room, count, root, low = -(-n // parts), [0] * parts, scratch_path(graph.vertices.sparkSession, "ldg"), None
    for i, high in enumerate(ends):
        mine = rows.where(F.col("id") <= high) if low is None else rows.where((F.col("id") > low) & (F.col("id") <= high))
        pairs = mine.select("id", F.explode_outer("near").alias("dst"))
        pairs = pairs.withColumn("part", F.lit(None).cast("int")) if low is None else pairs.join(_ldg_read(rows, root).withColumnRenamed("id", "dst"), "dst", "left")
        told = pairs.groupBy("id").agg(F.collect_list(F.when(F.col("part").isNull(), F.col("dst"))).alias("inner"), F.array(*(F.count_if(F.col("part") == p) for p in range(parts))).alias("placed"))

        def run(pdf: pd.DataFrame, count: list[int] = count) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            ids = pdf["id"].to_numpy(np.int64)
            g = Csr(ids, np.repeat(ids, pdf["inner"].map(len)), np.concatenate([*pdf["inner"], np.zeros(0, np.int64)]).astype(np.int64))
            return pd.DataFrame({"id": ids, "part": greedy_on(g, np.stack(pdf["placed"].to_list()), np.array(count), room).astype(np.int32)})

        told.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf), "id long, part int").write.parquet(f"{root}/range={i}")
        sums = {r["part"]: r["count"] for r in _ldg_read(rows, root).groupBy("part").count().collect()}  # one row a part
        count, low = [sums.get(p, 0) for p in range(parts)], high
    release(rows)
    return _ldg_read(graph.vertices, root)


#: Blocks of ids, about, whose sizes cut the greedy pass into ranges.
_BLOCKS = 20_000


def _ldg_read(df: DataFrame, root: str) -> DataFrame:
    return df.sparkSession.read.schema("id long, part int").parquet(f"{root}/range=*")


#: Moves into a part are let in by strength, and those of one strength by this many groups of ids.
_GROUPS = 256


def label_propagation(graph: Graph, parts: int, rounds: int = 5, slack: float = 1.03) -> DataFrame:
    """Rounds of moves to the part with most neighbours, up to a capacity; DataFrame only, any size.

    Moves into a part beyond its room are not made. The strongest go first: moves are
    counted by part, class of strength and group of ids, and whole groups are let in while
    there is room, so only those counts are ordered. Between adjacent parts of like pull
    half of the vertices move a round, else neighbours swap for ever.
    """
    edges = materialize(graph.edges.where("src != dst"), "lp-edges")
    now = materialize(random_parts(graph, parts), "lp")
    room = int(-(-now.count() * slack // parts))
    for i in range(rounds):
        near = edges.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "part").agg(F.count(F.lit(1)).alias("n"))
        pull = near.join(now.withColumnRenamed("part", "own"), "id").groupBy("id").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("b"), F.coalesce(F.max(F.when(F.col("part") == F.col("own"), F.col("n"))), F.lit(0)).alias("stay"), F.first("own").alias("own"))
        moves = pull.where((-F.col("b.p") != F.col("own")) & (F.col("b.n") > F.col("stay")) & (F.pmod(int_hash(F.col("id") + i), F.lit(2)) == 0))
        strength = F.floor(F.log2((F.col("b.n") - F.col("stay")).cast("double")) * 4).cast("int")
        moves = materialize(moves.select("id", (-F.col("b.p")).cast("int").alias("goal"), strength.alias("strength"), F.pmod(F.xxhash64("id"), F.lit(_GROUPS)).cast("int").alias("group")), "lp-moves")
        free = now.groupBy(F.col("part").alias("goal")).agg((F.lit(room) - F.count(F.lit(1))).alias("free"))
        first = Window.partitionBy("goal").orderBy(F.col("strength").desc(), "group")
        counts = moves.groupBy("goal", "strength", "group").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(first))
        let_in = counts.join(free, "goal", "left").where(F.col("upto") <= F.coalesce("free", F.lit(room))).select("goal", "strength", "group")
        goes = moves.join(let_in, ["goal", "strength", "group"], "left_semi").select("id", "goal")
        last, now = now, materialize(now.join(goes, "id", "left").select("id", F.coalesce("goal", "part").alias("part")), "lp")
        release(last, moves)
    release(edges)
    return now


def partition(graph: Graph, parts: int, method: str = "lp") -> DataFrame:
    """(id, part) by the named method; one part needs none."""
    if parts < 1:
        raise ValueError("parts must be positive")
    kind = parse_method(method)
    if parts == 1:
        return graph.vertices.select("id", F.lit(0).alias("part"))
    return {"round_robin": round_robin, "random": random_parts, "ldg": ldg, "lp": label_propagation, "multilevel": multilevel}[kind](graph, parts)


def cut_edges(graph: Graph, parts: DataFrame) -> DataFrame:
    """(src, dst, src_part, dst_part) of edges between parts, both directions."""
    left, right = parts.select(F.col("id").alias("src"), F.col("part").alias("src_part")), parts.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    return graph.edges.join(left, "src").join(right, "dst").where("src_part != dst_part").select("src", "dst", "src_part", "dst_part")


def boundary(graph: Graph, parts: DataFrame) -> DataFrame:
    """(id) of vertices at either end of a cut edge."""
    cut = cut_edges(graph, parts)
    return cut.select(F.col("src").alias("id")).unionByName(cut.select(F.col("dst").alias("id"))).distinct()


def members(graph: Graph, parts: DataFrame, k: int, copies: str = "halo") -> DataFrame:
    """(part, local_id, id, is_owned, is_boundary): each part's own vertices, then boundary copies.

    ``copies="all"`` adds every boundary vertex to every part; ``"halo"`` only those with
    a neighbour in the part, which is far less and still gives a proper colouring.
    """
    edge = boundary(graph, parts).withColumn("is_boundary", F.lit(True))
    own = parts.join(edge, "id", "left").select("part", "id", F.lit(True).alias("is_owned"), F.coalesce("is_boundary", F.lit(False)).alias("is_boundary"))
    if copies == "all":
        # k rows a boundary vertex, by a generator
        spread = edge.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("part"))
        others = spread.join(parts.withColumnRenamed("part", "own"), "id").where("part != own").select("part", "id")
    else:
        others = cut_edges(graph, parts).select(F.col("src_part").alias("part"), F.col("dst").alias("id")).distinct()
    every = own.unionByName(others.select("part", "id", F.lit(False).alias("is_owned"), F.lit(True).alias("is_boundary")))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col("is_owned").desc(), "id")) - 1
    return every.select("part", local.alias("local_id"), "id", "is_owned", "is_boundary")


def induced(graph: Graph, rows: DataFrame) -> DataFrame:
    """(part, src, dst): edges whose ends are both members of the part."""
    ids = rows.select("part", F.col("id").alias("src"))
    return graph.edges.join(ids, "src").join(rows.select("part", F.col("id").alias("dst")), ["part", "dst"]).select("part", "src", "dst")


def _order(g: Csr, local: np.ndarray, at_boundary: np.ndarray, theta: int) -> np.ndarray:
    """First to last: boundary, large, round, hash of the local id, local id."""
    pri = peel_local(g, "rgp", theta)["pri"].to_numpy()
    keys = [at_boundary.astype(np.int64), (g.degree >= LARGE_DEGREE).astype(np.int64), pri, hash32(local), local]
    return np.lexsort(keys[::-1])[::-1]


def boundary_graph(graph: Graph, edge: DataFrame) -> Graph:
    """The graph that the boundary vertices induce, with their ids."""
    ids = edge.select("id")
    inner = graph.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(ids, inner, graph.multigraph)


def color_boundary(graph: Graph, edge: DataFrame, theta: int) -> DataFrame:
    """(id, color) of the boundary vertices within the graph that they induce, in distributed rounds.

    Their order is: large, round, hash of the local id, local id; local ids ascend with ids.
    """
    sub = boundary_graph(graph, edge).stored("boundary")
    local = numbered(sub.vertices, "local", F.col("id"))
    rated = peel(sub, "rgp", theta).join(local, "id")
    key = F.struct(is_large(F.col("deg")).alias("large"), F.col("pri").alias("pri"), int_hash(F.col("local")).alias("hash"), F.col("local").alias("local"))
    return color_rounds(sub, materialize(rated.select("id", key.alias("key")), "keys")).select("id", "color")


#: What ``color_parts`` returns.
PARTED = "id long, part int, color int, ms double, worker string, peak_mb double, host_mb double"


def worker_figures() -> dict[str, object]:
    """This worker process, its peak memory and the memory of its host, in MB."""
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    return {"worker": f"{socket.gethostname()}:{os.getpid()}", "peak_mb": peak, "host_mb": os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**20}


def color_parts(graph: Graph, parts: DataFrame, k: int, theta: int = 10, copies: str = "halo") -> DataFrame:
    """(id, part, color, ms and the worker's figures): the boundary is coloured first, then each part on its own around it.

    Interior vertices of different parts are never neighbours, so taking each part's own
    vertices gives a proper colouring. One task holds one part and its copies, whose size is
    counted first: a graph of any size takes as many parts as keep each below
    ``LOCAL_EDGES``. ``ms`` is the time that the part's task took.
    """
    rows = materialize(members(graph, parts, k, copies), "members")
    edge = materialize(rows.where("is_owned AND is_boundary").select("id"), "edge")
    shared = color_boundary(graph, edge, theta).withColumnRenamed("color", "fixed")
    inner = materialize(induced(graph, rows), "induced")
    largest = inner.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > LOCAL_EDGES:
        raise ValueError(f"a part has {largest} edges, one task holds {LOCAL_EDGES}: use more parts")
    vertices = rows.join(shared, "id", "left").select("part", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "local_id", "is_owned", "is_boundary", F.coalesce("fixed", F.lit(-1)).alias("fixed"))
    edges = inner.select("part", "src", "dst", F.lit(0).alias("local_id"), F.lit(False).alias("is_owned"), F.lit(False).alias("is_boundary"), F.lit(-1).alias("fixed"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = time.perf_counter()
        own = pdf[pdf["dst"].isna()].sort_values("src")
        pairs = pdf[pdf["dst"].notna()]
        g = Csr(own["src"].to_numpy(np.int64), pairs["src"].to_numpy(np.int64), pairs["dst"].to_numpy(np.int64))
        order = _order(g, own["local_id"].to_numpy(np.int64), own["is_boundary"].to_numpy(bool), theta)
        color = first_fit(g, order, own["fixed"].to_numpy(np.int64))
        out = pd.DataFrame({"id": g.ids, "part": pdf["part"].iloc[0], "color": color, "ms": 1e3 * (time.perf_counter() - begin)})
        return out[own["is_owned"].to_numpy(bool)].assign(**worker_figures())

    return vertices.unionByName(edges).groupBy("part").applyInPandas(run, PARTED)


def part_edges(graph: Graph, parts: DataFrame) -> DataFrame:
    """(part, src, dst): edges within parts, once each, by local id in ascending id, the smaller one first."""
    local = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    ids = parts.select("part", "id", local.alias("lid"))
    left, right = ids.select("part", F.col("id").alias("src"), F.col("lid").alias("ls")), ids.select("part", F.col("id").alias("dst"), F.col("lid").alias("ld"))
    return graph.edges.join(left, "src").join(right, ["part", "dst"]).where("ls < ld").select("part", F.col("ls").alias("src"), F.col("ld").alias("dst")).distinct()
