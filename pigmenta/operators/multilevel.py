"""Partitions by levels: contract heavy edges, split the small graph, and refine on the way back.

A level's vertices have weights (how many original vertices they are) and so have its edges. Each vertex
names its heaviest edge, ties by a hash of the pair, so that an edge both of whose ends name it is a match; matches
become vertices of the next level. Where few match (around hubs, or without edges), light vertices that name the same
neighbour, or none, are gathered by a hash instead. Levels are stored tables, and matching and contraction are joins and
aggregates of any size. The last level has ``COARSE`` vertices or so, a size that does not grow with the graph; it is split
in one task, from several starts. Each level on the way back takes its parts from the level below and moves
vertices to the part that holds more of their edges' weight, within the capacity of the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import materialize, release

#: Vertices of the last level for each part, the most vertices and edges that its task takes, and most levels.
COARSE, COARSE_NODES, COARSE_EDGES, MOST_LEVELS = 250, 100_000, 5_000_000, 40
#: A part holds at most so many times its share.
SLACK = 1.05
#: Moves of one part and strength are let in by this many groups of ids.
_GROUPS = 64


def matched(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, up) of all vertices: the two ends of a match go up to the smaller id. ``most`` bounds the weight of a match."""
    weights = nodes.select(F.col("id").alias("dst"), F.col("w").alias("dst_w"))
    fits = edges.join(nodes.select(F.col("id").alias("src"), F.col("w").alias("src_w")), "src").join(weights, "dst").where(F.col("src_w") + F.col("dst_w") <= most)
    rank = F.struct(F.col("w"), F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")).alias("h"), F.greatest("src", "dst").alias("g"))
    pick = materialize(fits.groupBy("src").agg(F.max_by("dst", rank).alias("dst")), "picks")
    mutual = pick.join(pick.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    return nodes.join(mutual.select(F.col("src").alias("id"), F.least("src", "dst").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("up"))


def gathered(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, up) of all vertices: light ones whose heaviest edge leads to the same vertex, or that have none, go up some four together."""
    rank = F.struct(F.col("w"), F.xxhash64("dst").alias("h"), F.col("dst"))
    named = edges.groupBy(F.col("src").alias("id")).agg(F.max_by("dst", rank).alias("hub"))
    light = materialize(nodes.where(F.col("w") * 16 <= most).join(named, "id", "left").select("id", F.coalesce("hub", F.lit(-1)).alias("hub")), "light")
    sizes = light.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / 4)).cast("long")).alias("place")
    groups = light.join(sizes, "hub").select("id", "hub", place)
    heads = groups.groupBy("hub", "place").agg(F.min("id").alias("up"))
    return nodes.join(groups.join(heads, ["hub", "place"]).select("id", "up"), "id", "left").select("id", F.coalesce("up", "id").alias("up"))


def contracted(nodes: DataFrame, edges: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the next level; edges within a match go, parallel ones add up."""
    above = nodes.join(up, "id").groupBy(F.col("up").alias("id")).agg(F.sum("w").alias("w"))
    left, right = up.select(F.col("id").alias("src"), F.col("up").alias("a")), up.select(F.col("id").alias("dst"), F.col("up").alias("b"))
    joined = edges.join(left, "src").join(right, "dst").where("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
    return materialize(above, "level-nodes"), materialize(joined, "level-edges")


def split(weight: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, parts: int, room: float, starts: int = 8) -> np.ndarray:
    """Parts of a small graph: grown from random vertices, then improved vertex by vertex; the best of several starts."""
    n = len(weight)
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    at = np.searchsorted(src, np.arange(n + 1))
    best, least = None, np.inf
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        part, load, pull = np.full(n, -1), np.zeros(parts), np.zeros((n, parts))
        for p in range(parts - 1):
            while load[p] < weight.sum() / parts and (part < 0).any():
                free = np.flatnonzero(part < 0)
                near = pull[free, p]
                v = int(free[near.argmax()]) if near.max() > 0 else int(rng.choice(free))
                part[v], load[p] = p, load[p] + weight[v]
                pull[dst[at[v] : at[v + 1]], p] += w[at[v] : at[v + 1]]
        load[parts - 1] = weight[part < 0].sum()
        part[part < 0] = parts - 1
        for _ in range(12):
            moved = 0
            for v in rng.permutation(n).tolist():
                own, gain = part[v], np.bincount(part[dst[at[v] : at[v + 1]]], weights=w[at[v] : at[v + 1]], minlength=parts)
                score = np.where((load + weight[v] <= room) | (np.arange(parts) == own), gain, -1.0)
                goal = int(np.lexsort((load, -score))[0])
                if goal != own and (score[goal] > gain[own] or load[own] > room or score[goal] == gain[own] and load[goal] + weight[v] < load[own]):
                    load[own], load[goal], part[v] = load[own] - weight[v], load[goal] + weight[v], goal
                    moved += 1
            if not moved:
                break
        cut = w[part[src] != part[dst]].sum() + (1e18 if load.max() > room else 0)
        if cut < least:
            best, least = part, cut
    return best


def _split_last(nodes: DataFrame, edges: DataFrame, parts: int, room: float) -> DataFrame:
    if edges.count() > COARSE_EDGES or nodes.count() > COARSE_NODES:
        raise ValueError(f"the last level has more than {COARSE_NODES} vertices or {COARSE_EDGES} edges: the graph does not contract")
    rows = nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "w").unionByName(edges.select("src", "dst", "w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, pairs = pdf[pdf["dst"].isna()].sort_values("src"), pdf[pdf["dst"].notna()]
        ids = own["src"].to_numpy(np.int64)
        place = lambda c: np.searchsorted(ids, pairs[c].to_numpy(np.int64))
        return pd.DataFrame({"id": ids, "part": split(own["w"].to_numpy(float), place("src"), place("dst"), pairs["w"].to_numpy(float), parts, room).astype(np.int32)})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id long, part int")


def refined(nodes: DataFrame, edges: DataFrame, now: DataFrame, room: float, rounds: int) -> DataFrame:
    """Rounds of moves of ``now`` (id, part) that lessen the cut, the strongest first, within the room of each part.

    Vertices of a round are half of all, by a hash, so that neighbours do not swap for ever.
    """
    for i in range(rounds):
        own = now.withColumnRenamed("part", "own")
        near = edges.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "part").agg(F.sum("w").alias("pull")).join(own, "id")
        best = near.groupBy("id").agg(F.max(F.when(F.col("part") != F.col("own"), F.struct("pull", (-F.col("part")).alias("p")))).alias("b"), F.coalesce(F.max(F.when(F.col("part") == F.col("own"), F.col("pull"))), F.lit(0)).alias("stay"))
        gains = best.where((F.col("b.pull") > F.col("stay")) & (F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(2)) == 0)).join(nodes, "id")
        strength = F.floor(F.log2((F.col("b.pull") - F.col("stay")).cast("double")) * 4).cast("int")
        moves = materialize(gains.select("id", "w", (-F.col("b.p")).cast("int").alias("goal"), strength.alias("strength"), F.pmod(F.xxhash64("id"), F.lit(_GROUPS)).cast("int").alias("group")), "moves")
        free = now.join(nodes, "id").groupBy(F.col("part").alias("goal")).agg((F.lit(room) - F.sum("w")).alias("free"))
        upto = F.sum("n").over(Window.partitionBy("goal").orderBy(F.col("strength").desc(), "group"))
        let_in = moves.groupBy("goal", "strength", "group").agg(F.sum("w").alias("n")).withColumn("upto", upto).join(free, "goal").where("upto <= free").select("goal", "strength", "group")
        goes = moves.join(let_in, ["goal", "strength", "group"], "left_semi").select("id", "goal")
        last, now = now, materialize(now.join(goes, "id", "left").select("id", F.coalesce("goal", "part").alias("part")), "refined")
        release(last, moves)
    return now


def levels(nodes: DataFrame, edges: DataFrame, coarse: int, most: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame | None]]:
    """(vertices, edges, map to the next level or None) from the graph down to ``coarse`` vertices, or as far as it contracts."""
    n, pair = nodes.count(), matched
    for _ in range(MOST_LEVELS):
        if n <= coarse:
            break
        up = materialize(pair(nodes, edges, most), "matches")
        above, joined = contracted(nodes, edges, up)
        fewer = above.count()
        if fewer > 0.95 * n and pair is gathered:
            break
        pair = gathered if fewer > 0.75 * n and pair is matched else matched
        if fewer < n:
            yield nodes, edges, up
            nodes, edges, n = above, joined, fewer
    yield nodes, edges, None


def multilevel(graph: Graph, parts: int, rounds: int = 4, coarse: int | None = None) -> DataFrame:
    """(id, part): every vertex once, parts of at most ``SLACK`` times their share, few cut edges."""
    nodes = materialize(graph.vertices.select("id").distinct().withColumn("w", F.lit(1).cast("long")), "level-nodes")
    edges = materialize(graph.edges.where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "level-edges")
    n = nodes.count()
    room = max(-(-n // parts), int(n * SLACK / parts))
    stack = list(levels(nodes, edges, COARSE * parts if coarse is None else coarse, max(2, n // (20 * parts))))
    nodes, edges, _ = stack.pop()
    now = materialize(_split_last(nodes, edges, parts, room), "split")
    for nodes, edges, up in reversed(stack):
        now = materialize(up.join(now.withColumnRenamed("id", "up"), "up").select("id", "part"), "projected")
        now = refined(nodes, edges, now, room, rounds)
    return now
