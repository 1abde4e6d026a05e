"""Colour a graph file: ``python -m pigmenta -f graph.egr -a 0 -e 10``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.degrees import graph_status
from .plans import NUMBERS
from .plans.report import timed
from .session import ship_package
from .sources.files import read_graph


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pigmenta", description=__doc__)
    out.add_argument("-f", "--file", required=True, help="graph: .egr, .bin, .txt, .mmio, .mtx")
    out.add_argument("-a", "--algorithm", help="name, or number in the family; the first one, or sl_els_sdc for a graph in parts")
    out.add_argument("--family", choices=sorted(NUMBERS), default="device", help="what numbers mean")
    out.add_argument("-e", "--elastic", "-r", "--resilient", dest="theta", type=int, default=None, help="margin; 0, or 10 for a graph in parts")
    out.add_argument("--predict", choices=("linear", "svr"), help="predict the margin from the graph's size")
    out.add_argument("--vectors", help="table of the kernel model's support vectors")
    out.add_argument("-p", "--parts", type=int, default=1)
    out.add_argument("--partitioner", default="lp")
    out.add_argument("--copies", choices=("halo", "all"), default="halo")
    out.add_argument("--engine", choices=("dataframe", "local"), default="dataframe")
    out.add_argument("--status", action="store_true", help="print the graph's figures first")
    out.add_argument("--output", help="folder for the colours, as Parquet")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pigmenta").getOrCreate()
    ship_package(spark)
    graph = read_graph(spark, args.file)
    if args.status:
        print("\n".join(f"{k}: {v}" for k, v in graph_status(graph).first().asDict().items()))
    theta = args.predict or (args.theta if args.theta is not None else 10 if args.parts > 1 else 0)
    algorithm = args.algorithm or ("0" if args.parts == 1 else "sl_els_sdc")
    run = timed(graph, algorithm, theta, args.parts, args.partitioner, args.copies, engine=args.engine, vectors=args.vectors, family=args.family)
    print(run.log())
    if args.output:
        run.colors.write.mode("overwrite").parquet(args.output)
    return 0 if run.proper else 1


if __name__ == "__main__":
    sys.exit(main())
