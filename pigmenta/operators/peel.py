"""Priority assignment: vertices of low degree are taken away in rounds.

One loop serves all rules. A rule says up to which degree vertices go in a round, from
the round's number and the degrees of the vertices left; a round reads a snapshot (bulk
synchronous). ``theta`` is the elastic margin: a larger one takes more vertices a round,
so there are fewer rounds and a few more colours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import drop_split, read_split, scratch_path, write_split
from .resident import BUCKET_EDGES, bucketed


@dataclass(frozen=True)
class Left:
    """Vertices left before a round: their number, sum and smallest degree, and the smallest before the last decrement."""

    n: int
    total: int
    least: int
    least_before: int


@dataclass(frozen=True)
class Rule:
    """``base(round, left)`` is the round's threshold without the margin; ``pri`` gives the priority.

    ``strict``: the threshold is the least degree left in every round, so without a margin only vertices of that degree go.
    """

    base: Callable[[int, Left, int], float]
    margin: bool = True
    chain: str = "device"
    priority: str = "residual"
    strict: bool = False


def _pow2(exponent: int) -> float:
    return float(2 ** min(exponent, 62))


#: name -> rule; "sl" and "sll" come for the device chain and for the cpu chain.
RULES = {
    "sl_els": Rule(lambda r, left, f: 1 if r == 0 else left.least_before),
    "sl_els_sdc": Rule(lambda r, left, f: 1 if r == 0 else left.least),
    "rgp": Rule(lambda r, left, f: 1 if r == 0 else left.least, priority="round_margin"),
    "jp_sl": Rule(lambda r, left, f: left.least, strict=True),
    "jp_sll": Rule(lambda r, left, f: _pow2(r * (1 + f)), priority="round"),
    "jp_adg": Rule(lambda r, left, f: left.total // left.n, margin=False, priority="constant"),
    "jp_adg_fixed": Rule(lambda r, left, f: left.total // left.n, margin=False, priority="round"),
    "cpu_adg": Rule(lambda r, left, f: left.total / left.n, margin=False, chain="cpu"),
    "cpu_sl": Rule(lambda r, left, f: left.least, margin=False, chain="cpu", strict=True),
    "cpu_sll": Rule(lambda r, left, f: _pow2(r), margin=False, chain="cpu"),
}


def priority(rule: Rule, theta: int, round_: object, rdeg: object, base: object) -> object:
    """Priority of a vertex removed in a round; columns or arrays alike."""
    if rule.priority == "round":
        return round_
    if rule.priority == "round_margin":
        return (round_ + 1) * (theta + 1)
    if rule.priority == "constant":
        return round_ * 0
    return round_ * (theta + 1) + (rdeg - base) + 1


_STATE = "id long, deg long, rdeg long, before long"
_GONE = _STATE + ", theta double, round int"


def _totals() -> dict[str, Column]:
    stays = ~F.col("gone")
    of = lambda f, c: f(F.when(stays, F.col(c)))
    return {"n": F.count(F.when(stays, 1)), "s": of(F.sum, "rdeg"), "m": of(F.min, "rdeg"), "b": of(F.min, "before")}


def _left(row: dict) -> Left:
    return Left(row["n"], int(row["s"] or 0), row["m"], row["b"])


def peel(graph: Graph, rule: str, theta: int = 0, bucket_edges: int | None = None) -> DataFrame:
    """(id, deg, round, rdeg, theta, pri) of every vertex.

    A graph whose counted edges and vertices are one bucket (``resident``) is peeled within it, unless ``bucket_edges`` is 0. Others
    are peeled in groups of whole components (``pieces``), by the thresholds that all groups together give, in a job or
    two for all rounds. If a component is beyond ``bucket_edges`` (or ``LOCAL_EDGES``) or thresholds do not come to agree,
    the whole graph is peeled by one task with the edges on its disk (``disk``); if that has not got room
    for the vertices, or ``bucket_edges`` bound a task, each round is a job (``peel_rounds``).

    ``round`` counts from 0, ``rdeg`` is the degree left when the vertex went, ``theta`` the
    round's threshold without the margin.
    """
    from .local import in_one, peel_local
    from .pieces import pieces, thresholds

    ddl = "id long, deg long, round int, rdeg long, theta double, pri long"

    if bucket_edges != 0 and graph.edges.count() + graph.vertices.count() <= (bucket_edges or BUCKET_EDGES):
        return in_one(graph, lambda g: peel_local(g, rule, theta), ddl)
    groups = pieces(graph, bucket_edges)
    if groups is not None:
        bases = thresholds(groups, rule, theta)
        if bases is not None:
            return groups.stored(lambda g: peel_local(g, rule, theta, bases), ddl)
        groups.drop()
    return peel_rounds(graph, rule, theta, bucket_edges) if bucket_edges else peel_whole(graph, rule, theta)


def peel_whole(graph: Graph, rule: str, theta: int = 0, bucket_edges: int | None = None) -> DataFrame:
    """``peel`` without groups: by one task with the edges on its disk, or in rounds if ``bucket_edges`` bound a task or vertices are too many for one."""
    from .disk import fits_on_disk, on_disk
    from .local import peel_local

    if bucket_edges or not fits_on_disk(graph):
        return peel_rounds(graph, rule, theta, bucket_edges)
    return on_disk(graph, lambda g: peel_local(g, rule, theta), "id long, deg long, round int, rdeg long, theta double, pri long")


def peel_rounds(graph: Graph, rule: str, theta: int = 0, bucket_edges: int | None = None) -> DataFrame:
    """``peel`` in a job a round, whatever the components.

    The edges lie in a table bucketed by their source, which no round shuffles: vertices that go are brought to
    their edges, and only counts by target, summed up in each bucket, leave it. A round writes the vertices that go and those that
    stay to two folders of the shared store, and gathers the totals that the next threshold needs
    as it writes. Edges of vertices gone are dropped as the graph halves. All rounds are read back as one table.
    """
    kind = RULES[rule]
    margin = theta if kind.margin else 0
    spark = graph.vertices.sparkSession
    n_edges = graph.edges.count()
    root = scratch_path(spark, f"peel-{rule}")
    start = graph.degrees().select("id", "deg", F.col("deg").alias("rdeg"), F.col("deg").alias("before"), F.lit(0.0).alias("theta"), F.lit(False).alias("gone"))
    left = _left(write_split(start, f"{root}/start", "gone", **_totals()))
    if not left.n:
        return spark.createDataFrame([], "id long, deg long, round int, rdeg long, theta double, pri long")
    state, last = read_split(spark, f"{root}/start", "gone", False, _STATE), f"{root}/start"
    buckets = lambda n: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (bucket_edges or BUCKET_EDGES)))
    table = bucketed(graph.edges.select("src", "dst"), buckets(n_edges), "src", "edges")
    size, round_ = left.n, 0
    while left.n:
        edges = spark.table(table)
        base = kind.base(round_, left, theta)
        goes = F.col("rdeg") <= F.lit(float(base + margin))
        lost = edges.join(state.where(goes).select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
        rest = F.when(goes, F.col("rdeg")).otherwise(F.col("rdeg") - F.coalesce("lost", F.lit(0)))
        after = state.join(lost, "id", "left").select("id", "deg", rest.alias("rdeg"), F.col("rdeg").alias("before"), F.lit(float(base)).alias("theta"), goes.alias("gone"))
        path = f"{root}/round={round_}"
        left = _left(write_split(after, path, "gone", **_totals()))
        drop_split(spark, last, "gone", False)
        if left.n:
            state, last = read_split(spark, path, "gone", False, _STATE), path
            if left.n * 2 < size:
                before, ids = table, state.select("id")
                rest = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
                table = bucketed(rest, buckets(n_edges * left.n // size), "src", "edges")
                spark.sql(f"DROP TABLE {before}")
                n_edges, size = n_edges * left.n // size, left.n
        round_ += 1
    spark.sql(f"DROP TABLE {table}")
    out = read_split(spark, f"{root}/round=*", "gone", True, _GONE, root)
    pri = priority(kind, margin if rule != "rgp" else theta, F.col("round").cast("long"), F.col("rdeg"), F.col("theta").cast("long"))
    return out.select("id", "deg", "round", "rdeg", "theta", pri.cast("long").alias("pri"))
