"""Exact influence, marginals and the estimate-against-exact benchmark."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.functions.tables import settle
from cascadia.operators.reach import firsts, sizes
from cascadia.operators.sketch import estimate


def exact(live: DataFrame, seeds: DataFrame, l: int, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """q, exact: the mean number of vertices that each seed set (q, v) reaches over l instances."""
    return sizes(live, seeds, l, strategy=strategy).groupBy("q").agg((F.sum("size") / F.lit(l)).alias("exact"))


def marginals(live: DataFrame, steps: DataFrame, l: int, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """step, v, marginal: what each seed of a sequence (step, v) adds over l instances; all steps in one search."""
    found = firsts(live, steps.select(F.col("step").cast("long").alias("q"), "v"), l, strategy)
    first = found.groupBy("q").agg((F.sum("size") / F.lit(l)).alias("marginal"))
    return steps.select("step", "v").join(first, F.col("step") == F.col("q"), "left").select("step", "v", F.coalesce("marginal", F.lit(0.0)).alias("marginal"))


def benchmark(sketches: DataFrame, live: DataFrame, seeds: DataFrame, n: int, k: int, l: int, leval: int | None = None, strategy: str = "auto", times: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """(queries, sizes) for seed sets (size, q, slot, v): estimate, exact and relative error of each query, and their
    averages by size. live holds the leval (l if not given) instances to evaluate on. times: also vertices (the set
    with commas between), estimate_ms and exact_ms. All queries run in one job, so each gets an equal share of its time."""
    sets = seeds.select(F.concat_ws("_", "size", "q").alias("name"), "size", "q", "v")
    key = sets.select("size", "q").distinct().withColumn("k", F.xxhash64("size", "q"))
    own = sets.select(F.xxhash64("size", "q").alias("q"), "v")
    runs, spent = [estimate(sketches, own, n, k, l), exact(live, own, leval or l, strategy)], []
    for i, name in enumerate(("estimates", "exact") if times else ()):
        began = time.time()
        runs[i] = settle(runs[i], name)
        spent.append(1000 * (time.time() - began) / max(1, runs[i].count()))
    both = key.join(runs[0].withColumnRenamed("q", "k"), "k").join(runs[1].withColumnRenamed("q", "k"), "k")
    columns = ["estimate", "exact", "error"]
    queries = both.select("size", "q", "estimate", "exact", (F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")).alias("error"))
    if times:
        names = seeds.groupBy("size", "q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"].cast("string")), ",").alias("vertices"))
        queries = queries.join(names, ["size", "q"]).withColumns({"estimate_ms": F.lit(spent[0]), "exact_ms": F.lit(spent[1])})
        columns += ["estimate_ms", "exact_ms"]
    return queries, queries.groupBy("size").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in columns))


def cumulative(seeds: DataFrame) -> DataFrame:
    """Running sums over a maximisation's steps: they are as many as seeds were asked for."""
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return seeds.withColumn("cum_est", F.sum("est").over(upto)).withColumn("cum_exact", F.sum("exact").over(upto))
