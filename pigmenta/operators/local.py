"""Kernels for graphs that one task can hold, as numpy arrays.

They give the results of the DataFrame operators. ``on_one`` runs a kernel over the
edges as one group, whose size it counts first, or over groups of whole components (``pieces``).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import HASH_MULTIPLIER, LARGE_DEGREE
from ..graph import Graph
from .peel import RULES, Left, priority

#: Vertices and directed edges that one task may hold.
LOCAL_EDGES = 5_000_000


def hash32(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * np.uint64(HASH_MULTIPLIER)) & np.uint64(0xFFFFFFFF)
    return ((x >> np.uint64(16)) ^ x).astype(np.int64)


class Csr:
    """Vertices by position in ascending id, and their neighbours."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids = np.unique(ids)
        self.src, self.dst = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.argsort(self.src, kind="stable")
        self.src, self.dst = self.src[order], self.dst[order]
        self.n = len(self.ids)
        self.degree = np.bincount(self.src, minlength=self.n)
        self.start = np.concatenate([[0], np.cumsum(self.degree)])

    def neighbours(self, v: int) -> np.ndarray:
        return self.dst[self.start[v] : self.start[v + 1]]

    def lists(self, order: np.ndarray) -> Iterator[list[int]]:
        """The neighbours of each vertex in turn."""
        start = self.start.tolist()
        for v in order.tolist():
            yield self.dst[start[v] : start[v + 1]].tolist()

    def beside(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The neighbours of all ``rows``."""
        counts = self.degree[rows]
        first = np.repeat(self.start[rows] - (np.cumsum(counts) - counts), counts)
        yield self.dst[first + np.arange(len(first))]


#: What is made of a graph, as arrays or on disk (``disk.DiskCsr``).
Kernel = Callable[[Csr], pd.DataFrame]


def peel_local(g: Csr, rule: str, theta: int, bases: list[float] | None = None, seen: list[tuple] | None = None) -> pd.DataFrame:
    """Rounds, residual degrees, thresholds and priorities of one of the peeling rules.

    ``bases`` are the thresholds of the first rounds where more than ``g`` decides them; ``seen`` gets
    (round, vertices left, sum and least of their degrees, least before the last decrement, threshold) of each round.
    """
    kind = RULES[rule]
    margin = theta if kind.margin else 0
    deg = g.degree.copy()
    before = deg.copy()
    round_of, rdeg, thresholds = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64), np.zeros(g.n)
    left, round_ = np.arange(g.n), 0
    while len(left):
        d = deg[left]
        now = Left(len(left), int(d.sum()), int(d.min()), int(before[left].min()))
        base = bases[round_] if bases is not None and round_ < len(bases) else kind.base(round_, now, theta)
        if seen is not None:
            seen.append((round_, now.n, now.total, now.least, now.least_before, base))
        goes = d <= base + margin
        gone, left = left[goes], left[~goes]
        round_of[gone], rdeg[gone], thresholds[gone] = round_, d[goes], base
        before[left] = d[~goes]
        for near in g.beside(gone):
            np.subtract.at(deg, near, 1)
        round_ += 1
    pri = priority(kind, theta if rule == "rgp" else margin, round_of, rdeg, thresholds.astype(np.int64))
    return pd.DataFrame({"id": g.ids, "deg": g.degree, "round": round_of, "rdeg": rdeg, "theta": thresholds, "pri": pri})


def order_local(g: Csr, peeled: pd.DataFrame | None, chain: str, wrap: bool = False) -> np.ndarray:
    """Positions of the vertices, first to be coloured first."""
    from .order import CHAINS


    def column(name: str) -> np.ndarray:
        if name == "large":
            return g.degree >= LARGE_DEGREE
        if name in ("hash", "hash_signed"):
            hashes = hash32(g.ids)
            return hashes if name == "hash" else np.where(hashes >= 1 << 31, hashes - (1 << 32), hashes)
        if name == "minus_id":
            return -g.ids
        if peeled is not None and name in ("round", "rdeg", "pri"):
            found = peeled[name].to_numpy()
            return (found & 0xFFFFFFFF) | (1 << 30) if name == "pri" and wrap else found
        if name == "pri":
            return np.zeros(g.n, np.int64)
        return {"deg": g.degree, "id": g.ids}[name]

    return np.lexsort([column(c) for c in reversed(CHAINS[chain])])[::-1]


def first_fit(g: Csr, order: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
    """Colours by first fit in the order; ``fixed`` colours (-1: none) are kept."""
    color = np.full(g.n, -1, dtype=np.int64) if fixed is None else fixed.copy()
    out = color.tolist()
    if fixed is not None:
        order = order[fixed[order] < 0]
    for v, near in zip(map(int, order), g.lists(order)):
        taken = {out[u] for u in near if u != v}
        c = 0
        while c in taken:
            c += 1
        out[v] = c
    return np.array(out, dtype=np.int64)


def smallest_last(g: Csr) -> np.ndarray:
    """Removal index of each vertex, 1 for the first: always the least (degree, id).

    Only vertices of a degree up to ``level`` wait in heaps, one a degree; it rises to the least degree left when all are
    empty, so few vertices are put there more than once or twice and nothing grows with the edges.
    """
    deg = g.degree.tolist()
    index, n, level = [0] * g.n, 0, -1
    heaps: list[list[int]] = []
    while n < g.n:
        left = np.flatnonzero(np.array(index, dtype=np.int64) == 0)
        now = np.array(deg, dtype=np.int64)[left]
        level = int(now.min())
        heaps += [[] for _ in range(level + 1 - len(heaps))]
        heaps[level] = left[now == level].tolist()  # ascending, so a heap
        least = level
        while least <= level:
            if not heaps[least]:
                least += 1
                continue
            v = heapq.heappop(heaps[least])
            if index[v] or deg[v] != least:
                continue
            n += 1
            index[v] = n
            for u in g.neighbours(v).tolist():
                if not index[u]:
                    deg[u] = d = deg[u] - 1
                    if d <= level:
                        heapq.heappush(heaps[d], u)
                        if d < least:
                            least = d
    return np.array(index, dtype=np.int64)


def dsatur(g: Csr) -> np.ndarray:
    """Colours by saturation: most distinct colours beside it, then degree, then lowest id.

    Vertices wait in a heap for each saturation, by rank in degree and id; colours beside one are the bits of a number.
    A heap of which most have moved on is thinned out, so nothing grows with the edges.
    """
    order = np.lexsort([np.arange(g.n), -g.degree])
    rank = np.empty(g.n, dtype=np.int64)
    rank[order] = np.arange(g.n)
    at, vertex = rank.tolist(), order.tolist()
    del rank, order
    color, beside, saturation = [-1] * g.n, [0] * g.n, bytearray(4 * g.n)
    saturation = memoryview(saturation).cast("i")
    heaps, live, top = [list(range(g.n))], [g.n], 0
    for _ in range(g.n):
        while True:
            if not heaps[top]:
                top -= 1
                continue
            v = vertex[heapq.heappop(heaps[top])]
            if color[v] < 0 and saturation[v] == top:
                break
        taken = ~beside[v]
        bit = taken & -taken
        color[v] = bit.bit_length() - 1
        live[top] -= 1
        for u in g.neighbours(v).tolist():
            if color[u] < 0 and not beside[u] & bit:
                beside[u] |= bit
                s = saturation[u] + 1
                saturation[u] = s
                if s == len(heaps):
                    heaps.append([])
                    live.append(0)
                live[s - 1] -= 1
                live[s] += 1
                heapq.heappush(heaps[s], at[u])
                if s > top:
                    top = s
                if len(heaps[s - 1]) > 2 * live[s - 1] + 1000:
                    heaps[s - 1] = [r for r in heaps[s - 1] if color[vertex[r]] < 0 and saturation[vertex[r]] == s - 1]
                    heapq.heapify(heaps[s - 1])
        beside[v] = 0
    return np.array(color, dtype=np.int64)


def greedy_partition(g: Csr, parts: int) -> np.ndarray:
    """One pass in id order: the part with most placed neighbours less its fullness, at most 1.

    Ties go to the emptier part. If the winner is full, the vertex goes to the emptiest part.
    """
    return greedy_on(g, np.zeros((1, parts), dtype=np.int64), np.zeros(parts, dtype=np.int64), -(-g.n // parts))


def greedy_on(g: Csr, placed: np.ndarray, count: np.ndarray, room: int) -> np.ndarray:
    """The pass over ``g`` alone after parts have got ``count`` vertices; ``placed``: neighbours of each vertex by part among those (one row: of all)."""
    parts, part = len(count), np.full(g.n, -1, dtype=np.int64)
    for v in range(g.n):
        beside = part[g.neighbours(v)]
        score = np.bincount(beside[beside >= 0], minlength=parts) + placed[min(v, len(placed) - 1)] - np.minimum(count / room, 1.0)
        top = np.flatnonzero(score > score.max() - 1e-12)
        best = top[count[top].argmin()]
        if count[best] >= room:
            best = count.argmin()
        part[v] = best
        count[best] += 1
    return part


def fits(graph: Graph, most: int | None = None) -> bool:
    """Whether one task may hold the graph's directed edges and vertices together."""
    most = LOCAL_EDGES if most is None else most
    rows = graph.edges.select(F.lit(0)).limit(most + 1).unionAll(graph.vertices.select(F.lit(0)).limit(most + 1))
    return rows.limit(most + 1).count() <= most


class TooLarge(ValueError):
    """No task holds what a sequential kernel would need at once."""


def too_large(what: str) -> TooLarge:
    return TooLarge(f"{what} runs in one task, which holds {LOCAL_EDGES} vertices and edges at most")


def on_one(graph: Graph, kernel: Callable[[Csr], pd.DataFrame], schema: str, what: str = "the local engine") -> DataFrame:
    """Run a kernel over each group of whole components; raises if a component is beyond ``LOCAL_EDGES``.

    A graph that one task can hold is one group. What the kernel says of a component must not depend on others.
    """
    from .pieces import pieces

    if fits(graph):
        return in_one(graph, kernel, schema)
    found = pieces(graph)
    if found is None:
        raise too_large(what)
    return found.stored(kernel, schema)


def in_one(graph: Graph, kernel: Callable[[Csr], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel over a graph whose size the caller has counted, as one group."""
    rows = graph.vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(graph.edges.select("src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = pdf[pdf["dst"].notna()]
        return kernel(Csr(pdf["src"].to_numpy(np.int64), edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64)))

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf), schema)
