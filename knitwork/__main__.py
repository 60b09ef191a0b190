"""``python -m knitwork partition`` and ``python -m knitwork node``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from knitwork.functions.programs import ALGORITHMS, Result, run_algorithm
from knitwork.operators import layout
from knitwork.plans.supersteps import EDGE, VERTEX


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="knitwork")
    commands = parser.add_subparsers(dest="command", required=True)
    cut = commands.add_parser("partition", help="lay out a text hypergraph over partitions")
    cut.add_argument("source")
    cut.add_argument("partitions", type=int)
    cut.add_argument("-o", "--out", default=".")
    cut.add_argument("-p", "--partitioning", help="folder of files partition-<n> with the ids of uniques")
    cut.add_argument("--unique-side", choices=(EDGE, VERTEX), default=EDGE)
    node = commands.add_parser("node", help="run an algorithm on a layout")
    node.add_argument("algorithm", choices=tuple(ALGORITHMS))
    node.add_argument("layout")
    node.add_argument("-o", "--out", required=True, help="folder of the result")
    node.add_argument("-s", "--superstep-limit", type=int)
    node.add_argument("--source", type=int, default=0)
    node.add_argument("--unique-side", choices=(EDGE, VERTEX))
    node.add_argument("--compat", action="store_true")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> layout.Layout | Result:
    given = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("knitwork").getOrCreate()
    if given.command == "partition":
        return layout.partition(spark, given.source, given.partitions, given.out, given.unique_side, given.partitioning)
    graph = layout.to_hypergraph(layout.read(spark, given.layout))
    found = run_algorithm(given.algorithm, graph, given.superstep_limit, given.source, given.unique_side, given.compat, trace=True)
    found.write(given.out)
    return found


if __name__ == "__main__":
    main()
