"""Colour assignment over DataFrames.

All rules give the same colouring for one total order: a vertex takes the smallest
colour that no neighbour before it has. ``color_rounds`` computes it in bulk
synchronous rounds between buckets, each of which goes as far as it can on its own; ``speculate``
in fewer rounds with repairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mex
from ..graph import Graph
from ..scratch import materialize, read_split, release, scratch_path, write_split
from .order import dag
from .resident import EDGE, MIRROR, ROUTE, settle

#: Words of a set of colours, and the colours they hold; larger colours go to a list.
_WORDS = 4
_SMALL = 64 * _WORDS
_W = [f"w{k}" for k in range(_WORDS)]
#: Rows between rounds: the state of an open vertex; a colour; what a vertex may still take; what a bucket's
#: vertices told a hub (``n`` of them) and may still take from it; and decided vertices.
STATE, COLOR, RIVAL, TOLD, HELD, DONE = range(6)
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("id", pa.int64()), ("color", pa.int32()), ("n", pa.int32()), ("waits", pa.int32()), *((w, pa.int64()) for w in _W), ("more", pa.list_(pa.int32()))])
_ROW_DDL = ", ".join(["bucket int, id long, color int, n int, waits int", *(f"{w} long" for w in _W), "more array<int>"])


def _column(table: pa.Table, name: str, kind: np.dtype = np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind, copy=False) if table.num_rows else np.zeros(0, kind)


def _words(table: pa.Table) -> np.ndarray:
    return np.stack([_column(table, w) for w in _W], 1).view(np.uint64) if table.num_rows else np.zeros((0, _WORDS), np.uint64)


def _bits(color: np.ndarray) -> np.ndarray:
    """Words with the bit of each colour; none for a large one."""
    out = np.zeros((len(color), _WORDS), dtype=np.uint64)
    small = np.flatnonzero(color < _SMALL)
    out[small, color[small] >> 6] = np.uint64(1) << (color[small] & 63).astype(np.uint64)
    return out


def _or_by(group: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The words of each of ``n`` groups joined by OR."""
    out = np.zeros((n, _WORDS), dtype=np.uint64)
    if len(group):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        out[group[order][first]] = np.bitwise_or.reduceat(words[order], first, axis=0)
    return out


def _up_to(n: np.ndarray) -> np.ndarray:
    """Words with the bits of the colours 0 to ``n``."""
    have = np.clip(n[:, None] + 1 - 64 * np.arange(_WORDS)[None], 0, 64).astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(have >= 64, full, (np.uint64(1) << np.minimum(have, np.uint64(63))) - np.uint64(1))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` are in the ascending ``keys``; -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Bucket:
    """The open vertices of a bucket and what they know."""

    def __init__(self, table: pa.Table, rows: pa.Table) -> None:
        kind, self.told = _column(table, "kind"), _column(rows, "kind")
        ids, others, goals = (_column(table, c, k) for c, k in (("id", np.int64), ("other", np.float64), ("goal", np.float64))) if table.num_rows else (np.zeros(0, np.int64),) * 3
        if table.num_rows:  # nulls stand in columns that a kind does not use
            others = table.column("other").fill_null(-1).to_numpy()
            goals = table.column("goal").fill_null(-1).to_numpy()
        self.routes = ids[kind == ROUTE], goals[kind == ROUTE]
        states = rows.filter(pa.array(self.told == STATE)).sort_by("id") if rows.num_rows else rows
        self.id, self.n, self.waits = (_column(states, c) for c in ("id", "n", "waits"))
        self.waits = self.waits.copy()
        self.taken = _words(states).copy()
        self.more = {i: set(m) for i, m in enumerate(states.column("more").to_pylist()) if m} if states.num_rows else {}
        self.color = np.full(len(self.id), -1, dtype=np.int64)
        near = kind == EDGE
        row = _find(self.id, ids[near])
        self.row, self.other = row[row >= 0], others[near][row >= 0]  # edges of open vertices
        self.source = _find(self.id, self.other)
        mirror = kind == MIRROR
        held = _find(self.id, others[mirror])
        self.hub, self.hub_goal, self.hub_source = ids[mirror][held >= 0], goals[mirror][held >= 0], held[held >= 0]
        self.beside = np.zeros((len(self.id), _WORDS), dtype=np.uint64)  # what open vertices of other buckets may take
        self.heard = np.bincount(self.row[self.source >= 0], minlength=len(self.id))  # neighbours before it of which it is known what they may take
        if rows.num_rows:
            self._receive(rows)
        self.beside[self.heard < self.waits] = ~np.uint64(0)  # of the others, in the first round, nothing is

    def _receive(self, rows: pa.Table) -> None:
        """Apply what other buckets say."""
        of = lambda kind: rows.filter(pa.array(self.told == kind))
        news = of(COLOR).sort_by("id")
        at = _find(_column(news, "id"), self.other)
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            self._take(self.row[hit], _column(news, "color")[at[hit]])
        rivals = of(RIVAL).sort_by("id")
        at = _find(_column(rivals, "id"), self.other)
        hit = np.flatnonzero(at >= 0)
        self.beside |= _or_by(self.row[hit], _words(rivals)[at[hit]], len(self.id))
        self.heard += np.bincount(self.row[hit], minlength=len(self.id))
        for kind in (TOLD, HELD):
            news = of(kind)
            row = _find(self.id, _column(news, "id"))
            news, row = news.filter(pa.array(row >= 0)), row[row >= 0]  # a hub may be decided before all of its neighbours
            n = np.bincount(row, weights=_column(news, "n"), minlength=len(self.id)).astype(np.int64)
            words = _or_by(row, _words(news), len(self.id))
            if kind == HELD:
                self.heard += n
                self.beside |= words
                continue
            self.waits -= n
            self.taken |= words
            for i, m in zip(row.tolist(), news.column("more").to_pylist()):
                if m:
                    self.more.setdefault(i, set()).update(m)

    def _take(self, row: np.ndarray, color: np.ndarray) -> None:
        """Neighbours before the vertices ``row`` have got these colours."""
        self.waits -= np.bincount(row, minlength=len(self.id))
        self.taken |= _or_by(row, _bits(color), len(self.id))
        for i in np.flatnonzero(color >= _SMALL).tolist():
            self.more.setdefault(int(row[i]), set()).add(int(color[i]))

    def _first_free(self, rows: np.ndarray) -> np.ndarray:
        free = ~self.taken[rows]
        word = (free != 0).argmax(1)
        lowest = free[np.arange(len(rows)), word]
        lowest &= ~lowest + np.uint64(1)
        out = 64 * word + np.bitwise_count(lowest - np.uint64(1))
        for i in np.flatnonzero(lowest == 0).tolist():
            color, taken = _SMALL, self.more.get(int(rows[i]), ())
            while color in taken:
                color += 1
            out[i] = color
        return out

    def possible(self) -> np.ndarray:
        return _up_to(self.n) & ~self.taken

    def color_all(self) -> None:
        """Colour what can be coloured, again and again until nothing more can without news from outside."""
        inner = np.flatnonzero(self.source >= 0)
        while True:
            rows = np.flatnonzero(self.color < 0)
            inner = inner[(self.color[self.row[inner]] < 0) & (self.color[self.source[inner]] < 0)]
            rivals = self.beside | _or_by(self.row[inner], self.possible()[self.source[inner]], len(self.id))
            color = self._first_free(rows)
            free = (color < _SMALL) & ~(_bits(color) & rivals[rows]).any(1)
            done = (self.waits[rows] == 0) | free
            if not done.any():
                return
            self.color[rows[done]] = color[done]
            hit = inner[(self.color[self.source[inner]] >= 0) & (self.color[self.row[inner]] < 0)]
            self._take(self.row[hit], self.color[self.source[hit]])

    def says(self, bucket: int) -> pa.Table:
        """Rows for the next round: own open states, what goes to other buckets and to hubs, and what is decided."""
        out, open_ = [], np.flatnonzero(self.color < 0)
        possible = self.possible()

        def put(kind: int, goal: object, id_: np.ndarray, color: object = None, n: object = None, waits: object = None, words: np.ndarray | None = None, more: list | None = None) -> None:
            if len(id_):
                full = lambda x, t: pa.nulls(len(id_), t) if x is None else pa.array(np.broadcast_to(x, len(id_)), t)
                cells = [full(words[:, k].view(np.int64) if words is not None else None, pa.int64()) for k in range(_WORDS)]
                out.append(pa.Table.from_arrays([full(np.int32(kind), pa.int32()), full(goal, pa.int32()), pa.array(id_), full(color, pa.int32()), full(n, pa.int32()), full(waits, pa.int32()), *cells, pa.array(more if more is not None else [None] * len(id_), pa.list_(pa.int32()))], schema=_ROW))

        put(STATE, bucket, self.id[open_], n=self.n[open_], waits=self.waits[open_], words=np.ascontiguousarray(self.taken[open_]), more=[sorted(self.more.get(i, ())) for i in open_.tolist()])
        done = np.flatnonzero(self.color >= 0)
        put(DONE, bucket, self.id[done], color=self.color[done])
        at = _find(self.id, self.routes[0])
        told, goal = at[at >= 0], self.routes[1][at >= 0]
        now = self.color[told] >= 0
        put(COLOR, goal[now], self.id[told[now]], color=self.color[told[now]])
        put(RIVAL, goal[~now], self.id[told[~now]], words=np.ascontiguousarray(possible[told[~now]]))
        hubs, which = np.unique(self.hub, return_inverse=True)
        home = np.zeros(len(hubs), dtype=np.int64)
        home[which] = self.hub_goal
        now = self.color[self.hub_source] >= 0
        color = self.color[self.hub_source[now]]
        n = np.bincount(which[now], minlength=len(hubs))
        large: dict[int, set[int]] = {}
        for i in np.flatnonzero(color >= _SMALL).tolist():
            large.setdefault(int(which[now][i]), set()).add(int(color[i]))
        some = np.flatnonzero(n)
        put(TOLD, home[some], hubs[some], n=n[some], words=_or_by(which[now], _bits(color), len(hubs))[some], more=[sorted(large.get(i, ())) for i in some.tolist()])
        n = np.bincount(which[~now], minlength=len(hubs))
        rest = np.flatnonzero(n)
        put(HELD, home[rest], hubs[rest], n=n[rest], words=_or_by(which[~now], possible[self.hub_source[~now]], len(hubs))[rest])
        return pa.concat_tables(out) if out else _ROW.empty_table()


def _round(table: pa.Table, rows: pa.Table) -> pa.Table:
    bucket = Bucket(table, rows)
    bucket.color_all()
    return bucket.says(rows.column("bucket")[0].as_py() if rows.num_rows else 0)


def color_rounds(graph: Graph, keys: DataFrame, most_rounds: int | None = None, bucket_edges: int | None = None, hub_edges: int | None = None, seen: Callable[[int], None] | None = None) -> DataFrame:
    """(id, color) for the order of ``keys``.

    Vertices lie in buckets with the neighbours that come before them (``resident``), whose number
    follows the counted edges; a graph of one bucket takes one round. In a round each bucket
    takes in what the others said and colours every vertex whose neighbours before it have their
    colours, and those for which the first colour left is one that no undecided neighbour before it can
    take (such a neighbour cannot take what its own decided ones forbid, nor a colour above its number of neighbours
    before it). It goes on with what it has just coloured until nothing more can be, so chains within a bucket
    take no rounds. Then it sends each vertex's colour, or the colours left to it, once to each bucket where
    vertices wait for it. The order has one colouring, so buckets and rounds do not change it.

    A round is one job. The first undecided vertex is decided in each; ``most_rounds`` is as in ``speculate``.
    ``seen`` is called with the number of rounds.
    """
    spark = graph.vertices.sparkSession
    root = scratch_path(spark, "colors")
    edges = materialize(dag(graph, keys).withColumnRenamed("higher", "other"), "dag")
    size = edges.count()
    counts = edges.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    home = settle(edges, size, bucket_edges, hub_edges)
    n = F.coalesce("n", F.lit(0))
    zero = F.lit(0).cast("long")
    rows = graph.vertices.select("id").distinct().join(counts, "id", "left").select(
        F.lit(STATE).alias("kind"), home.bucket("id").alias("bucket"), "id", F.lit(None).cast("int").alias("color"), n.alias("n"), n.alias("waits"), *(zero.alias(w) for w in _W), F.array().cast("array<int>").alias("more")
    )
    rounds, left = 0, 1
    while left:
        if rounds == most_rounds:
            home.drop()
            raise RuntimeError(f"vertices are left after {rounds} rounds")
        path = f"{root}/round-{rounds}"
        made = home.step(rows, _round, f"kind int, {_ROW_DDL}").withColumn("done", F.col("kind") == DONE)
        totals = write_split(made, path, "done", left=F.count(F.when(F.col("kind") == STATE, 1)), done=F.count(F.when(F.col("done"), 1)))
        left = totals["left"]
        if rounds:
            release(rows)
        rounds += 1
        if left:
            rows = read_split(spark, path, "done", False, f"kind int, {_ROW_DDL}")
    home.drop()
    release(edges)
    if seen is not None:
        seen(rounds)
    if rounds == 1 and not totals["done"]:
        return spark.createDataFrame([], "id long, color int")
    return spark.read.schema("id long, color int").parquet(f"{root}/round-*/done=true")


def speculate(graph: Graph, keys: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(id, color): all vertices try at once, the later end of each conflict tries again.

    The result is proper but need not be that of the order. A vertex that keeps its colour
    is final. Each round makes at least one final, so rounds go on until none is left; if
    ``most_rounds`` are given and do not suffice, it raises.
    """
    edges = materialize(graph.edges.where("src != dst").distinct(), "conflicts")
    keys = materialize(keys, "keys")
    final = materialize(keys.select("id", F.lit(0).alias("color")).where("false"), "final")
    todo = keys.select("id")
    rounds = 0
    while todo.head(1):
        if rounds == most_rounds:
            raise RuntimeError(f"vertices are left after {rounds} rounds")
        rounds += 1
        used = edges.join(final.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("taken"))
        tried = materialize(todo.join(used, "id", "left").select("id", mex(F.coalesce("taken", F.array().cast("array<int>"))).alias("color")), "tried")
        rated = tried.join(keys, "id")
        low = rated.select(F.col("id").alias("src"), F.col("color").alias("c1"), F.col("key").alias("k1"))
        high = rated.select(F.col("id").alias("dst"), F.col("color").alias("c2"), F.col("key").alias("k2"))
        lost = edges.join(low, "src").join(high, "dst").where((F.col("c1") == F.col("c2")) & (F.col("k2") > F.col("k1"))).select(F.col("src").alias("id")).distinct()
        final = materialize(final.unionByName(tried.join(lost, "id", "left_anti")), "final")
        todo = materialize(lost, "todo")
    return final
