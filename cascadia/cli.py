"""Command line: `python -m cascadia.cli maximize -i graph.metis -N 10` and `... oracle -i graph.metis -N 1-5`."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from cascadia.functions.tables import settle
from cascadia.operators import influence, report, sampling, sketch
from cascadia.operators.greedy import maximize, quality_gap
from cascadia.operators.live import MODELS, SEED, live_edges
from cascadia.sources import binary, text

READERS = {"metis": text.metis, "dimacs": text.dimacs, "bin": binary.read, "parquet": text.read_arcs}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cascadia", description="Influence under the Independent Cascade model")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text_ in (("maximize", "choose seeds greedily"), ("oracle", "estimate the influence of random seed sets, or with -a of every vertex")):
        c = sub.add_parser(name, help=text_)
        c.add_argument("-i", dest="input", required=True, help="the graph")
        c.add_argument("-type", dest="kind", choices=READERS, default="metis")
        c.add_argument("-undir", dest="undirected", action="store_true")
        c.add_argument("-trans", dest="transpose", action="store_true")
        c.add_argument("-nopar", dest="drop_parallel", action="store_true")
        c.add_argument("-m", dest="model", choices=sorted(MODELS), default="weighted")
        c.add_argument("-p", dest="probability", type=float, default=0.1)
        c.add_argument("-k", type=int, default=64)
        c.add_argument("-l", type=int, default=64)
        c.add_argument("-seed", type=int, default=SEED)
        c.add_argument("-t", dest="threads", type=int, help="shuffle partitions; threads are Spark's")
        c.add_argument("-numa", type=int, help="accepted and not used: executors are placed by the cluster")
        c.add_argument("-v", dest="silent", action="store_true", help="print no summary")
        c.add_argument("-os", dest="statistics", help="folder for the statistics")
    one, two = sub.choices["maximize"], sub.choices["oracle"]
    one.add_argument("-N", dest="seeds", type=int, default=0)
    one.add_argument("-leval", type=int, default=0)
    one.add_argument("-oc", dest="coverage", help="folder for the coverage")
    two.add_argument("-N", dest="sizes", default="1-50")
    two.add_argument("-leval", type=int)
    two.add_argument("-n", dest="queries", type=int, default=100)
    two.add_argument("-g", dest="method", choices=("uni", "neigh"), default="uni")
    two.add_argument("-a", dest="every", action="store_true")
    return p


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """What the command prints, as a DataFrame."""
    a = parser().parse_args(arguments)
    if a.threads:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.threads))
    options = {"transpose": a.transpose, "drop_parallel": a.drop_parallel} | ({"directed": False} if a.undirected else {})
    graph = READERS[a.kind](spark, a.input, **options)
    arcs = graph.arcs.count()
    if a.command == "maximize":
        seeds = settle(maximize(graph, a.model, a.seeds, a.k, a.l, a.leval, a.seed, a.probability), "seeds")
        if a.statistics:
            report.seed_statistics(seeds, graph.n, arcs).write.text(a.statistics)
        if a.coverage:
            report.coverage(seeds, graph.n).write.text(a.coverage)
        if not a.silent:
            print("\n".join(report.summary(seeds, graph.n, arcs, a.seed)))
        return quality_gap(seeds)
    began = time.time()
    index = settle(sketch.build(graph, a.model, a.k, a.l, a.seed, a.probability), "index")
    spent = 1000 * (time.time() - began)
    if a.every:
        every = sketch.estimate_all(index, graph.n, a.k, a.l)
        if a.statistics:
            report.influence_lines(every).write.text(a.statistics)
        return every
    sizes, leval = sampling.parse_ranges(a.sizes), a.leval or a.l
    seeds = settle(sampling.uniform(spark, graph.n, sizes, a.queries) if a.method == "uni" else sampling.neighborhood(graph, sizes, a.queries), "sets")
    live = settle(live_edges(graph, a.model, leval, a.seed, a.probability), "live")
    queries, averages = influence.benchmark(index, live, seeds, graph.n, a.k, a.l, leval, times=bool(a.statistics))
    if a.statistics:
        size = sketch.sizes(index).first()
        totals = {
            "NumberOfVertices": graph.n, "NumberOfArcs": arcs, "PreprocessingElapsedMilliseconds": spent, "NumberOfQueries": a.queries,
            "SeedGenerator": a.method, "SeedSizeRange": a.sizes, "TotalSketchesSize": size["entries"], "TotalSketchesBytes": size["bytes"],
        }
        report.query_statistics(queries, averages, totals).write.text(a.statistics)
    return averages.select("size", "queries", "estimate", "exact", "error")


def main() -> None:
    import sys

    run(SparkSession.builder.appName("cascadia").getOrCreate(), sys.argv[1:]).show(100, truncate=False)


if __name__ == "__main__":
    main()
