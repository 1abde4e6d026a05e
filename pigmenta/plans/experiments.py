"""Runs of algorithms, and the best of them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.verify import verify

RUNS = "dataset string, algorithm string, theta int, parts int, partitioner string, run_idx int, color int, runtime_ms double, nodes long, edges long, ok boolean, error string"

def best_runs(runs: DataFrame, by_runtime: bool = True) -> DataFrame:
    """The best run of each dataset and algorithm: fewest colours, then fastest, or the first of them."""
    tie = "runtime_ms" if by_runtime else "run_idx"
    order = Window.partitionBy("dataset", "algorithm").orderBy("color", tie, "run_idx")
    return runs.where("color IS NOT NULL").withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


T = TypeVar("T")


def within(spark: SparkSession, seconds: float | None, work: Callable[[], T]) -> T:
    """The result of ``work``; its Spark jobs are cancelled and ``TimeoutError`` is raised after ``seconds``."""
    if seconds is None:
        return work()
    context, tag, late = spark.sparkContext, f"run-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    begin, timer = time.perf_counter(), threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"more than {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if time.perf_counter() - begin > seconds:
        raise TimeoutError(f"more than {seconds} s")
    return out


def measure(
    spark: SparkSession,
    graphs: dict[str, Graph],
    algorithms: Iterable[str],
    thetas: Iterable[int] = (0,),
    parts: Iterable[int] = (1,),
    partitioners: Iterable[str] = ("lp",),
    repeats: int = 1,
    timeout: float | None = None,
    skip_on_timeout: bool = False,
    skip_dataset_on_timeout: bool = False,
    stop_after_failure: bool = False,
    **options: object,
) -> DataFrame:
    """Run every combination and return one row a run; a run that fails is a row with its error.

    ``timeout`` ends a run after so many seconds. After one, ``skip_on_timeout`` leaves out the
    other repeats of its combination, ``skip_dataset_on_timeout`` the rest of its dataset;
    ``stop_after_failure`` leaves out the other repeats after any failure. ``options`` go to ``color``.
    """
    from . import color

    rows = []
    for dataset, graph in graphs.items():
        nodes, edges = graph.vertices.count(), graph.edges.count()  # directed entries, as logs and models count
        late = False
        for name, theta, k, partitioner in ((a, t, k, p) for a in algorithms for t in thetas for k in parts for p in (partitioners if k > 1 else (None,))):
            for i in range(repeats):
                if late and skip_dataset_on_timeout:
                    break
                begin, key = time.perf_counter(), (dataset, name, theta, k, partitioner, i)
                used, error = None, None

                def run(name=name, theta=theta, k=k, partitioner=partitioner):
                    return verify(graph, color(graph, name, theta, parts=k, partitioner=partitioner or "lp", **options)).first()

                try:
                    found = within(spark, timeout, run)
                    used = int(found["colors_used"])
                    error = "not proper" if found["uncolored"] or found["conflicts"] else None
                except TimeoutError:
                    error, late = "timeout", True
                except Exception as failure:  # a run that fails is a result of the grid
                    error = f"{type(failure).__name__}: {str(failure)[:500]}"
                rows.append((*key, used, 1e3 * (time.perf_counter() - begin) if used is not None else None, nodes, edges, error is None, error))
                if error == "timeout" and skip_on_timeout or error and stop_after_failure:
                    break
    return spark.createDataFrame(rows, RUNS)
