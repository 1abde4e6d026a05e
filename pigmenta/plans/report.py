"""Timed runs: how long the order, the colours and the phases took, and a log of it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.coloring import color_rounds
from ..operators.partition import color_parts, partition
from ..operators.verify import throughput, verify
from ..scratch import materialize
from . import algorithm, check_options, color, margin, order_keys
from .logs import LINES, PREDICTED, written


@dataclass(frozen=True)
class Device:
    """A worker process that coloured parts: how many, for how long, its peak memory and its host's memory."""

    device: int
    parts: int
    exec_ms: float
    max_mem_mb: float
    total_mem_mb: float


#: The phase that the runtime leaves out: the graph is split before the clock starts.
PARTITION_PHASE = "Partition Time"


@dataclass
class Run:
    """A finished colouring, stored, with its figures. ``edges`` are directed entries; ``phases`` are milliseconds by name."""

    colors: DataFrame
    nodes: int
    edges: int
    theta: int
    predicted: bool
    colors_used: int
    proper: bool
    phases: dict[str, float]
    rounds: int | None = None
    devices: list[Device] = field(default_factory=list)

    @property
    def runtime_ms(self) -> float:
        """All phases but the partition's."""
        return sum(ms for name, ms in self.phases.items() if name != PARTITION_PHASE)

    def summary(self) -> DataFrame:
        """(phase, ms, mnodes_per_s, medges_per_s), the runtime as ``total`` last."""
        rows = [*self.phases.items(), ("total", self.runtime_ms)]
        figures = [(name, ms, *throughput(self.nodes, self.edges, max(ms, 1e-6) / 1e3).values()) for name, ms in rows]
        return self.colors.sparkSession.createDataFrame(figures, "phase string, ms double, mnodes_per_s double, medges_per_s double")

    def log(self) -> str:
        """The run as lines that ``parse_logs`` and ``parse_devices`` read."""
        lines = [written("nodes", self.nodes), written("edges", self.edges), written("theta", self.theta, note=PREDICTED if self.predicted else ""), written("runtime_ms", f"{self.runtime_ms:.6f}", "ms"), written("color", self.colors_used)]
        if self.rounds is not None:
            lines.append(written("iter_count", self.rounds))
        lines += [f"{name:<30}: {ms:10.4f} ms" for name, ms in self.phases.items()]
        lines += [f"| {d.device} | {d.parts} | {d.exec_ms:.4f} | {d.max_mem_mb:.2f} | {d.total_mem_mb:.2f} |" for d in self.devices]
        return "\n".join(lines)


def timed(graph: Graph, algorithm_name: str = "sl_els", theta: int | str = 0, parts: int = 1, partitioner: str = "lp", copies: str = "halo", vectors: DataFrame | str | None = None, family: str = "device", **options: object) -> Run:
    """Colour a graph phase by phase. A phase ends when its result is stored, so the times add up.

    Whole graphs have the phases ``PA`` (the order) and ``CA`` (the colours), and ``rounds``,
    the number of peeling rounds. Graphs in parts have the partition, the boundary and its colours,
    the parts (``devices`` tells which worker coloured how many) and the merge. ``options`` are those of ``color``.
    """
    stored = graph.stored()
    nodes, edges = stored.vertices.count(), stored.edges.count()
    predicted = theta in ("linear", "svr")
    value = margin(stored, theta, vectors)
    what = algorithm(algorithm_name, family)
    engine, wrap, tie, seed = (options.get(k, default) for k, default in (("engine", "dataframe"), ("wrap", False), ("tie", "hash"), ("seed", 0)))
    if extra := set(options) - {"engine", "wrap", "tie", "seed"}:
        raise TypeError(f"unknown options: {', '.join(sorted(extra))}")
    check_options(what, engine, parts, wrap, tie)
    phases, rounds, devices = {}, None, []
    begin = time.perf_counter()

    def phase(name: str) -> None:
        nonlocal begin
        now = time.perf_counter()
        phases[name], begin = 1e3 * (now - begin), now

    if parts > 1:
        split = materialize(partition(stored, parts, partitioner), "parts")
        phase(PARTITION_PHASE)
        planned = color_parts(stored, split, parts, value, copies)
        phase(LINES["phase_1_ms"].title)
        made = materialize(planned, "parted")
        phase(LINES["phase_2_ms"].title)
        colors = materialize(made.select("id", "color"), "colors")
        phase(LINES["phase_3_ms"].title)
        of_worker = made.groupBy("worker", "part").agg(F.max("ms").alias("ms"), F.max("peak_mb").alias("peak"), F.max("host_mb").alias("host")).groupBy("worker")
        found = of_worker.agg(F.count(F.lit(1)).alias("parts"), F.sum("ms").alias("ms"), F.max("peak").alias("peak"), F.max("host").alias("host")).orderBy("worker").collect()  # one row a worker
        devices = [Device(i, r["parts"], r["ms"], r["peak"], r["host"]) for i, r in enumerate(found)]
    elif what.kernel or engine == "local":
        colors = materialize(color(stored, algorithm_name, value, family=family, **options), "colors")
        phase("CA")
    else:
        if what.rule:
            from ..operators.order import keyed
            from ..operators.peel import peel

            peeled = peel(stored, what.rule, value)
            rounds = (peeled.agg(F.max("round")).first()[0] or 0) + 1
            keys = materialize(keyed(peeled, "random" if tie == "random" else what.chain, wrap, seed), "keys")
        else:
            keys = order_keys(stored, what, value, wrap, tie, seed)
        phase("PA")
        colors = materialize(color_rounds(stored, keys).select("id", "color"), "colors")
        phase("CA")
    found = verify(stored, colors).first()
    return Run(colors, nodes, edges, value, predicted, int(found["colors_used"]), not found["uncolored"] and not found["conflicts"], phases, rounds, devices)
