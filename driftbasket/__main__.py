"""python -m driftbasket EDGES: baskets of a file of edges by all three algorithms, with run-times and quality reports."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.baskets import baskets
from .operators.quality_report import benchmark_report
from .operators.walks import monte_carlo
from .scratch import discard, materialize
from .sources.edge_csv import read_edge_csv


def run(spark: SparkSession, path: str, K: int = 50, L: int = 100, iterations: int = 30, damping: float = 0.85, tolerance: float = 1e-4, threads: int = 4, walks: int = 1000, nodes: int = 200) -> None:  # noqa: N803
    """Print the numbers of nodes and edges, and for each algorithm its run-time and report. Walks keep twice L entries."""
    graph = read_edge_csv(spark, path)
    print(f"nodes: {graph.vertices.count()} edges: {graph.edges.count()}")
    algorithms: dict[str, Callable[[], DataFrame]] = {
        "parallel baskets": lambda: baskets(graph, K, L, iterations, damping, tolerance, nThreads=threads),
        "baskets": lambda: baskets(graph, K, L, iterations, damping, tolerance),
        "walks": lambda: monte_carlo(graph, K, 2 * L, walks, damping),
    }
    for name, algorithm in algorithms.items():
        began = time.monotonic()
        found = materialize(algorithm(), "result")
        print(f"{name} run-time = {round(1000 * (time.monotonic() - began))} ms")
        print("-------")
        for key, value in benchmark_report(found, graph, nodes, True).first().asDict().items():
            print(f"{key}     {value}")
        print("-------")
        discard([found])


def main() -> None:
    parser = argparse.ArgumentParser(prog="driftbasket", description=__doc__)
    parser.add_argument("edges", help="lines of two numbers with a comma between them")
    for name, kind, default in (("K", int, 50), ("L", int, 100), ("iterations", int, 30), ("damping", float, 0.85), ("tolerance", float, 1e-4), ("threads", int, 4), ("walks", int, 1000), ("nodes", int, 200)):
        parser.add_argument(f"--{name}", type=kind, default=default)
    args = vars(parser.parse_args())
    run(SparkSession.builder.getOrCreate(), args.pop("edges"), **args)


if __name__ == "__main__":
    main()
