"""Greedy influence maximisation by ranks taken in ascending order."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.functions.tables import settle
from cascadia.operators.graph import Graph
from cascadia.operators.influence import cumulative, marginals
from cascadia.operators.live import INSTANCES, SEED, live_edges
from cascadia.operators.ranks import stratified
from cascadia.operators.reach import LOCAL, bounds, largest, pack, reach, search, sizes, spread
from cascadia.operators.sketch import per_instance

#: The share of all ranks that is taken at first; it doubles as long as no vertex has k of them.
FIRST = 1 / 256
#: The share of all ranks after which uncovered pairs are counted, to know whether any vertex has k. They are counted at
#: once where more ranks than that are likely to be needed.
COUNTED = 1 / 16
#: The share of the largest count from which on counts are made, so that they serve later steps too.
SLACK = 3 / 4
#: Tables of covered pairs that are read side by side before they are written as one.
TABLES = 16


def maximize(graph: Graph, model: str = "weighted", n_seeds: int = 0, k: int = 64, l: int = INSTANCES, leval: int = 0, seed: int = SEED, p: float = 0.1, strategy: str = "auto", ranks: DataFrame | None = None) -> DataFrame:  # noqa: E741
    """step (from 1), v, est, exact, saturated, cum_est, cum_exact of a greedy sequence of n_seeds seeds (0: n), and
    sketch_ms and exact_ms, the time spent on estimates and on exact influence up to then, and ranks_used.

    A seed is the vertex whose k-th smallest uncovered reachable rank is smallest, estimated to add (k - 1) n / (that
    rank + 1). Once no vertex has k uncovered pairs left, sizes are exact and the largest wins. Ties go to the
    smallest vertex; the sequence ends early when all is covered. What a seed reaches counts as exact in the sketches'
    own instances, or, with leval, in as many others.

    Only ranks below a bound are followed back to the vertices that reach them; the bound doubles when no vertex has k
    of them. What reaches an uncovered pair is uncovered itself, so entries found stay right until their own pair is
    covered, and each rank is followed once. Where many ranks would have to be followed, uncovered pairs are counted
    without keeping them, of the vertices whose bounds() reach a floor: k, and where no count reaches it, a part of the
    largest count. From then on entries are kept of vertices that have k alone, of none if none has; where these reach
    few pairs, a search from each of them finds all its entries in place of following ranks. The counts lose what seeds
    have covered when they are looked at. One row a step comes to the driver.
    """
    if k < 2:
        raise ValueError("k is 2 at least")
    spark, n = graph.arcs.sparkSession, graph.n
    live = settle(live_edges(graph, model, l, seed, p), "live")
    ranks = settle(ranks if ranks is not None else stratified(spark, n, l).select("v", "i", "rank"), "ranks")
    total = ranks.agg(F.max("rank")).first()[0]
    total = 0 if total is None else total + 1
    packed = settle(pack(live), "packed") if strategy == "worlds" or strategy == "auto" and largest(live) <= LOCAL else None
    covered: list[DataFrame] = []
    entries, counts, upto, many = None, None, 0, 0
    floor, share, tops, since = k, 1.0, None, []
    chosen: list[tuple] = []
    spent = [0.0, 0.0]

    def open_pairs(low: int, high: int) -> DataFrame:
        """The pairs with ranks from low to high that are not covered."""
        found = ranks.where((F.col("rank") >= low) & (F.col("rank") < high)).select("v", "i", "rank")
        return found.join(reduce(DataFrame.unionByName, covered), ["i", "v"], "left_anti") if covered else found

    def every_rank(vertices: DataFrame) -> DataFrame:
        """u, rank: the uncovered pairs that some vertices (u) reach."""
        found = reach(live, vertices.select(F.col("u").alias("q"), F.col("u").alias("v")), l, strategy="worlds" if packed is not None else "rounds")
        return open_pairs(0, total).join(found, ["i", "v"]).select(F.col("q").alias("u"), "rank")

    def counted() -> DataFrame:
        """u, size: how many uncovered pairs the vertices reach that may reach floor of them, a share of all pairs by
        the bounds. floor sinks to 1, which stands for all vertices, where the share is over a half."""
        nonlocal floor, share, tops
        some, share = graph.vertices(), 1.0
        if packed is not None and floor > l:
            tops = tops if tops is not None else settle(bounds(packed, l), "bounds")
            top, every = tops.agg(F.max("size"), F.sum("size")).first()
            floor = min(floor, int((top or 0) * SLACK))
            if floor > l:
                high = tops.where(F.col("size") >= floor)
                share = high.agg(F.sum("size")).first()[0] / every
                some = high.select(F.col("u").alias("v"))
        if share > 0.5:
            some, floor, share = graph.vertices(), 1, 1.0
        return settle(_counts(live, some, l, covered, "worlds" if packed is not None else strategy), "counts")

    while len(chosen) < (n_seeds or n):
        began = time.time()
        while True:
            best = most = None
            if entries is not None:
                per = entries.groupBy("u").agg(F.count("*").alias("size"), F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("rank")), k)).alias("kth"))
                r = per.agg(F.min(F.when(F.col("kth").isNotNull(), F.struct("kth", "u"))).alias("best"), F.max("size").alias("many")).first()
                best, many = r["best"], r["many"] or 0
            if best is not None:
                break
            hard = upto * k > many * total * COUNTED if upto else k > total * FIRST * COUNTED
            if counts is None and (hard or upto >= total * COUNTED):
                counts = counted()
            if counts is not None:
                if since:
                    counts, since = settle(_left(counts, live, since, l, packed is not None), "counts"), []
                most = counts.agg(F.max(F.struct("size", -F.col("u"))).alias("most")).first()["most"]
                if floor > 1 and (most is None or most["size"] < floor):
                    floor = int((most["size"] if most is not None else floor - 1) * SLACK)
                    counts = counted()
                    continue
                if most is None or most["size"] < k:
                    break
                if upto < total:
                    pairs, own = counts.agg(F.sum("size"), F.sum(F.when(F.col("size") >= k, F.col("size")))).first()
                    if own * most["size"] <= pairs / share * k:  # fewer than ranks up to a k-th would find
                        entries, upto = settle(every_rank(counts.where(F.col("size") >= k)), "entries"), total
                        continue
            low, upto = upto, min(total, max(2 * upto, k, int(total * FIRST)))
            fresh = _reaching(live, open_pairs(low, upto), l, packed is not None).select("u", "rank")
            if counts is not None:
                fresh = fresh.join(counts.where(F.col("size") >= k).select("u"), "u", "left_semi")
            entries = settle(fresh if entries is None else entries.unionByName(fresh), "entries")
        spent[0] += time.time() - began
        began = time.time()
        if best is not None:
            u, value, saturated, used = best["u"], (k - 1) * n / (best["kth"] + 1), False, best["kth"] + 1
        elif most is not None:
            u, value, saturated, used = -most["col2"], most["size"] / l, True, total
        else:
            break
        # what a covered pair reaches is covered, so that the search may pass covered pairs
        found = spread(packed, u, l) if packed is not None else reach(live, spark.createDataFrame([(0, u)], "q long, v long"), l, strategy="rounds").select("i", "v")
        fresh = settle(found.join(reduce(DataFrame.unionByName, covered), ["i", "v"], "left_anti") if covered else found, "fresh")
        count = fresh.count() / l
        spent[1] += time.time() - began
        began = time.time()
        chosen.append((len(chosen) + 1, u, float(value), count, saturated, *(1000 * x for x in spent), used))
        gone = ranks.where(F.col("rank") < upto).join(fresh, ["i", "v"]).select("rank")
        if counts is not None:
            since = [*since, fresh] if len(since) < TABLES else [settle(reduce(DataFrame.unionByName, [*since, fresh]), "since")]
        if saturated:  # then no vertex has k pairs any more
            entries = None
        elif len(chosen) < (n_seeds or n):
            entries = settle(entries.join(gone, "rank", "left_anti"), "entries")
        covered.append(fresh)
        if len(covered) > TABLES:
            covered = [settle(reduce(DataFrame.unionByName, covered), "covered")]
        spent[0] += time.time() - began
    seeds = spark.createDataFrame(chosen, "step int, v long, est double, exact double, saturated boolean, sketch_ms double, exact_ms double, ranks_used long")
    if leval and chosen:
        other = live if leval == l else settle(live_edges(graph, model, leval, seed, p), "live")
        again = marginals(other, seeds, leval, strategy).select("step", F.col("marginal").alias("exact"))
        seeds = seeds.drop("exact").join(again, "step").select(*seeds.columns)
    return cumulative(seeds)


def _reaching(live: DataFrame, pairs: DataFrame, l: int, local: bool) -> DataFrame:  # noqa: E741
    """u, rank: the vertices that reach each of some pairs (v, i, rank) in its instance, a row for each pair."""
    if not local:
        return per_instance(live, pairs, None, "rounds").select("u", "rank")
    back = live.select("i", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return search(back, pairs.select(F.col("rank").alias("q"), "i", "v"), l, "pairs", largest(pairs)).select(F.col("v").alias("u"), F.col("q").alias("rank"))


def _counts(live: DataFrame, vertices: DataFrame, l: int, covered: list[DataFrame], strategy: str) -> DataFrame:  # noqa: E741
    """u, size: how many uncovered pairs each of some vertices (v) reaches, 1 at least."""
    found = sizes(live, vertices.select(F.col("v").alias("q"), "v"), l, reduce(DataFrame.unionByName, covered) if covered else None, strategy)
    return found.groupBy(F.col("q").alias("u")).agg(F.sum("size").alias("size"))


def _left(counts: DataFrame, live: DataFrame, since: list[DataFrame], l: int, local: bool) -> DataFrame:  # noqa: E741
    """counts without pairs (i, v) that were covered since."""
    gone = reduce(DataFrame.unionByName, since).withColumn("rank", F.col("v"))
    lost = _reaching(live, gone, l, local).groupBy("u").agg(F.count("*").alias("lost"))
    left = counts.join(lost, "u", "left").select("u", (F.col("size") - F.coalesce("lost", F.lit(0))).alias("size"))
    return left.where("size > 0")


def quality_gap(seeds: DataFrame) -> DataFrame:
    """One row: seeds, est and exact spread, and how far the exact one stays behind, in per cent."""
    return seeds.agg(F.count("*").alias("seeds"), F.sum("est").alias("est"), F.sum("exact").alias("exact"), (100 * (1 - F.sum("exact") / F.sum("est"))).alias("gap"))
