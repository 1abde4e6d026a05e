"""Algorithms as combinations of a priority rule, a tie-break chain and first fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.coloring import color_rounds, speculate
from ..operators.disk import fits_on_disk, on_disk
from ..operators.local import Csr, dsatur, first_fit, fits, in_one, order_local, peel_local, smallest_last, too_large
from ..operators.order import keyed
from ..operators.partition import color_parts, partition
from ..operators.peel import RULES, peel, peel_whole
from ..operators.pieces import pieces, thresholds
from ..operators.resident import BUCKET_EDGES
from ..scratch import materialize
from .theta import kernel_theta, linear_theta, read_vectors


@dataclass(frozen=True)
class Algorithm:
    """``rule`` is a peeling rule or None; ``chain`` orders vertices; ``kernel`` is a sequential one."""

    rule: str | None = None
    chain: str = "device"
    kernel: str | None = None


ALGORITHMS = {
    "sl_els": Algorithm("sl_els"),
    "sl_els_sdc": Algorithm("sl_els_sdc"),
    "jp_sl": Algorithm("jp_sl"),
    "jp_sll": Algorithm("jp_sll"),
    "jp_adg": Algorithm("jp_adg"),
    "jp_adg_fixed": Algorithm("jp_adg_fixed"),
    "cpu_sl": Algorithm("cpu_sl", "cpu"),
    "cpu_sll": Algorithm("cpu_sll", "cpu"),
    "cpu_adg": Algorithm("cpu_adg", "cpu"),
    "ldf": Algorithm(None, "large_degree"),
    "ecl": Algorithm(None, "degree"),
    "greedy": Algorithm(None, "degree_id"),
    "natural": Algorithm(None, "natural"),
    "smallest_last": Algorithm(kernel="smallest_last"),
    "dsatur": Algorithm(kernel="dsatur"),
    "speculative": Algorithm(None, "large_degree", kernel="speculative"),
}
#: Other names.
ALIASES = {"cusl_els": "sl_els", "cusl_els_sdc": "sl_els_sdc", "cusl": "jp_sl", "jp-sl": "jp_sl", "jp-adg": "jp_adg", "jp-sll": "jp_sll", "sdl": "smallest_last", "p_sl_els": "sl_els", "p_sl_els_sdc": "sl_els_sdc"}
#: Numbers of the command lines, by family.
NUMBERS = {"device": ("sl_els", "sl_els_sdc"), "jp": ("jp_sl", "jp_adg", "jp_sll")}
ENGINES = ("dataframe", "local", "disk")


def algorithm(name: str, family: str = "device") -> Algorithm:
    """An algorithm by name, in any case, or by its number in a family."""
    key = str(name).lower()
    if key.isdigit() and int(key) < len(NUMBERS[family]):
        key = NUMBERS[family][int(key)]
    key = ALIASES.get(key, key)
    if key not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {name}; known: {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[key]


def check_engine(engine: str) -> str:
    if engine not in ENGINES:
        raise ValueError(f"unknown engine: {engine}; known: {', '.join(ENGINES)}")
    return engine


def check_options(what: Algorithm, engine: str, parts: int, wrap: bool, tie: str) -> None:
    """Raise where an option would not act, so that it is never passed over in silence."""
    if parts > 1 and (what.rule != "sl_els_sdc" or what.kernel or wrap or tie != "hash" or engine != "dataframe"):
        raise ValueError("graphs in parts are coloured by sl_els_sdc with ties by hash: give no other algorithm, engine, wrap or tie")
    if tie not in ("hash", "random"):
        raise ValueError(f"unknown tie-break: {tie}")
    if tie == "random" and (engine != "dataframe" or what.kernel or what.chain not in ("device", "large_degree")):
        raise ValueError("random ties are for orders by peeling or degree in the distributed engine")
    if wrap and not what.rule:
        raise ValueError("only a peeling rule has priorities to wrap")


_PEEL_DDL = "id long, deg long, round int, rdeg long, theta double, pri long"


def priorities(graph: Graph, rule: str, theta: int = 0, engine: str = "dataframe", bucket_edges: int | None = None) -> DataFrame:
    """(id, deg, round, rdeg, theta, pri) of a peeling rule, by either engine; ``bucket_edges`` is as in ``peel``."""
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    if check_engine(engine) == "local" and fits(graph):
        return in_one(graph, lambda g: peel_local(g, rule, theta), _PEEL_DDL)
    if engine == "disk":
        return on_disk(graph, lambda g: peel_local(g, rule, theta), _PEEL_DDL)
    return peel(graph, rule, theta, 0 if engine == "local" else bucket_edges)


def _local_color(g: Csr, what: Algorithm, theta: int, wrap: bool, bases: list[float] | None = None, peeled: pd.DataFrame | None = None) -> pd.DataFrame:
    """Colours by the algorithm; ``peeled`` has rounds, residual degrees and priorities in ascending id where they are known."""
    if what.kernel == "smallest_last":
        order = np.argsort(smallest_last(g))[::-1]
    elif what.kernel == "dsatur":
        return pd.DataFrame({"id": g.ids, "color": dsatur(g).astype(np.int32)})
    else:
        if what.rule and peeled is None:
            peeled = peel_local(g, what.rule, theta, bases)
        order = order_local(g, peeled, what.chain, wrap)
    return pd.DataFrame({"id": g.ids, "color": first_fit(g, order).astype(np.int32)})


_COLOR_DDL = "id long, color int"


def _color_pieces(graph: Graph, what: Algorithm, theta: int, wrap: bool, most: int | None) -> DataFrame | None:
    """Colours of groups of whole components; None if there are none.

    If their thresholds do not come to agree, the graph is peeled as a whole (``peel_whole``), and only coloured in groups.
    """
    groups = pieces(graph, most)
    if groups is None:
        return None
    bases = thresholds(groups, what.rule, theta) if what.rule else None
    if what.rule and bases is None:
        peeled = peel_whole(graph, what.rule, theta).select("id", "round", "rdeg", "pri")
        return groups.stored_with(peeled, lambda g, rows: _local_color(g, what, theta, wrap, peeled=rows), _COLOR_DDL)
    return groups.stored(lambda g: _local_color(g, what, theta, wrap, bases), _COLOR_DDL)


def margin(graph: Graph, theta: int | str, vectors: DataFrame | str | None = None) -> int:
    """The elastic margin: a number, or what the ``"linear"`` or the ``"svr"`` model predicts.

    Models count each edge once a direction, as their training did. The kernel model's support
    vectors are a table (v, e, alpha) or the path of one.
    """
    if theta not in ("linear", "svr"):
        return int(theta)
    v, e = graph.vertices.count(), graph.edges.count()
    if theta == "linear":
        return linear_theta(v, e)
    if vectors is None:
        raise ValueError("the kernel model needs its support vectors")
    return kernel_theta(v, e, read_vectors(graph.vertices.sparkSession, vectors) if isinstance(vectors, str) else vectors)


def color(
    graph: Graph, algorithm_name: str | None = None, theta: int | str = 0, engine: str = "dataframe", parts: int = 1, partitioner: str = "lp",
    copies: str = "halo", wrap: bool = False, tie: str = "hash", seed: int = 0, vectors: DataFrame | str | None = None, family: str = "device",
    bucket_edges: int | None = None,
) -> DataFrame:
    """(id, color) of every vertex.

    ``theta`` is the elastic margin, or names a model of it (``margin``). With ``parts`` above 1
    the graph is split, its boundary coloured first and the parts on their own, by the one order that is
    defined for parts (``sl_els_sdc``, ties by hash); other options raise then. The
    default engine is distributed throughout; ``local`` gives the same colours in one task, of
    graphs whose counted size it can hold. Larger graphs are coloured in groups of whole components (``operators.pieces``)
    by either engine; if no task can hold one of the components, not by the local one, and by the default one as ``disk`` does it:
    by one task that holds the vertices and has the edges on its disk (``operators.disk``). With more vertices than that holds, or bounded by ``bucket_edges``,
    the default engine goes in rounds between buckets. Smallest-last and saturation are sequential by definition and always local or on disk. ``tie="random"`` breaks ties by ``seed`` instead of the hash. ``bucket_edges``
    bounds what one task holds of a distributed graph (``operators.resident``).
    """
    what = algorithm(default_algorithm(parts) if algorithm_name is None else algorithm_name, family)
    check_engine(engine)
    margin_ = margin(graph, theta, vectors)
    check_options(what, engine, parts, wrap, tie)
    if parts > 1:
        stored = graph.stored()
        split = materialize(partition(stored, parts, partitioner), "parts")
        return color_parts(stored, split, parts, margin_, copies).select("id", "color")
    if what.kernel == "speculative":
        return speculate(graph, keyed(graph.degrees(), what.chain))
    if engine == "disk":
        return on_disk(graph, lambda g: _local_color(g, what, margin_, wrap), _COLOR_DDL, what.kernel or "the disk engine")
    alone = what.kernel or engine == "local"
    if alone and fits(graph):
        return in_one(graph, lambda g: _local_color(g, what, margin_, wrap), _COLOR_DDL)
    if tie == "hash" and (alone or not fits(graph, bucket_edges or BUCKET_EDGES)):
        found = _color_pieces(graph, what, margin_, wrap, bucket_edges)
        if found is not None:
            return found
        if alone:
            raise too_large(what.kernel or "the local engine")
        if not bucket_edges and fits_on_disk(graph):
            return on_disk(graph, lambda g: _local_color(g, what, margin_, wrap), _COLOR_DDL)
        return color_rounds(graph, order_keys(graph, what, margin_, wrap, tie, seed, bucket_edges, peel_whole), bucket_edges=bucket_edges)
    return color_rounds(graph, order_keys(graph, what, margin_, wrap, tie, seed, bucket_edges), bucket_edges=bucket_edges)


def default_algorithm(parts: int = 1) -> str:
    return "sl_els" if parts == 1 else "sl_els_sdc"


def order_keys(
    graph: Graph, what: Algorithm, theta: int, wrap: bool = False, tie: str = "hash", seed: int = 0, bucket_edges: int | None = None,
    by: Callable[..., DataFrame] = peel,
) -> DataFrame:
    """(id, key) of the vertices, peeled by ``by`` where the algorithm has a rule; stored."""
    vertices = by(graph, what.rule, theta, bucket_edges) if what.rule else graph.degrees().withColumn("pri", F.lit(0).cast("long"))
    return materialize(keyed(vertices, "random" if tie == "random" else what.chain, wrap, seed), "keys")
