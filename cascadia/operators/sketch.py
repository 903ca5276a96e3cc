"""Bottom-k reachability sketches and the estimates they give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.functions.tables import settle
from cascadia.operators.reach import LOCAL, STEP, gather, largest, neighbours, reach, search, worlds

#: Entries that a task holds before it hands on lists of them, and vertices whose lists it hands on at once.
HELD, LISTS = 1 << 22, 1 << 16


def _smallest(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy("rank")
    return df.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= k)


def _grower(most: int):
    """Lets ranks (q) flow backwards in ascending order through an instance, past vertices that have most already no
    further: i, u, ranks. A vertex has a row for each HELD entries that came between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, (src, dst, ranks, v) = gather(batches)
        ids, dense = np.unique(np.concatenate([src, dst, v]), return_inverse=True)
        m = len(src)
        into = neighbours(dense[m : 2 * m], dense[:m], len(ids))
        order = np.argsort(ranks, kind="stable")
        ranks, starts = ranks[order], dense[2 * m :][order].tolist()
        del src, dst, v, dense, order
        have, mark = [0] * len(ids), [-1] * len(ids)
        us, ats, counts, held, size = [], [], [], [], 0

        def keys() -> np.ndarray:
            return np.array(us, np.int64) << 32 | np.repeat(np.array(ats, np.int64), counts)

        def lists() -> Iterator[pa.RecordBatch]:
            every = np.concatenate([*held, np.empty(0, np.int64)])
            held.clear()
            every.sort()
            first = np.flatnonzero(np.diff(every >> 32, prepend=-1))
            first = np.append(first, len(every))
            for low in range(0, len(first) - 1, LISTS):
                own = first[low : low + LISTS + 1]
                part = every[own[0] : own[-1]]
                values = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ranks[part & 0xFFFFFFFF]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own) - 1, i, np.int32)), pa.array(ids[part[own[:-1] - own[0]] >> 32]), values], names=["i", "u", "ranks"])

        for at, start in enumerate(starts):
            if have[start] >= most:
                continue
            mark[start] = at
            seen = [start]
            for x in seen:
                have[x] += 1
                for y in into[x]:
                    if mark[y] != at and have[y] < most:
                        mark[y] = at
                        seen.append(y)
            us += seen
            ats.append(at)
            counts.append(len(seen))
            if len(us) >= STEP:
                held.append(keys())
                size += len(us)
                us, ats, counts = [], [], []
                if size >= HELD:
                    yield from lists()
                    size = 0
        held.append(keys())
        yield from lists()

    return run


def lists(live: DataFrame, ranks: DataFrame, k: int, strategy: str = "auto") -> DataFrame:
    """i, u, ranks: as per_instance(), the ranks of a vertex in one or several lists."""
    if strategy == "worlds" or strategy == "auto" and max(largest(live), largest(ranks)) <= LOCAL:
        top = live.agg(F.max("i")).first()[0], ranks.agg(F.max("i")).first()[0]
        return worlds(live, ranks.select(F.col("rank").alias("q"), "i", "v"), _grower(k), "i int, u long, ranks array<long>", max(x if x is not None else 0 for x in top) + 1)
    return per_instance(live, ranks, k, "rounds").select("i", "u", F.array("rank").alias("ranks"))


def per_instance(live: DataFrame, ranks: DataFrame, k: int | None, strategy: str = "auto") -> DataFrame:
    """i, u, rank: for each instance and vertex the k smallest ranks (None: all) among the pairs it reaches there.
    ranks: v, i, rank.

    "worlds" lets ranks flow backwards in ascending order through one instance in a task, past vertices that have k
    already no further; "rounds" sends newly entered ranks one arc back in each job, keeping k a vertex. "auto" takes
    the first where an instance has at most reach.LOCAL arcs and ranks."""
    if strategy != "rounds" and k:
        return lists(live, ranks, k, strategy).select("i", "u", F.explode("ranks").alias("rank"))
    if strategy == "worlds" or strategy == "auto" and max(largest(live), largest(ranks)) <= LOCAL:
        back = live.select("i", F.col("dst").alias("src"), F.col("src").alias("dst"))
        top = ranks.groupBy("i").count().agg(F.max("i"), F.max("count")).first()
        return search(back, ranks.select(F.col("rank").alias("q"), "i", "v"), (top[0] or 0) + 1, "pairs", top[1] or 0).select("i", F.col("v").alias("u"), F.col("q").alias("rank"))
    sketch = fresh = settle(ranks.select(F.col("i").cast("int").alias("i"), F.col("v").alias("u"), "rank"), "sketch")
    while True:
        sent = fresh.withColumnRenamed("u", "dst").join(live, ["i", "dst"]).select("i", F.col("src").alias("u"), "rank").distinct()
        sent = sent.join(sketch, ["i", "u", "rank"], "left_anti").withColumn("new", F.lit(True))
        both = sketch.withColumn("new", F.lit(False)).unionByName(sent)
        both = settle(_smallest(both, ["i", "u"], k).drop("pos") if k else both, "sketch")
        sketch, fresh = both.drop("new"), both.where("new").drop("new")
        if fresh.isEmpty():
            return sketch


def combined(sketches: DataFrame, k: int) -> DataFrame:
    """u, pos (from 1), rank: the k smallest ranks over all instances, of single ranks or lists()."""
    if "ranks" not in sketches.columns:
        return _smallest(sketches.select("u", "rank"), ["u"], k).select("u", "pos", "rank")
    own = sketches.groupBy("u").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ranks"))), 1, k).alias("ranks"))
    return own.select("u", F.posexplode("ranks").alias("pos", "rank")).select("u", (F.col("pos") + 1).alias("pos"), "rank")


def of(live: DataFrame, ranks: DataFrame, vertices: DataFrame, k: int, l: int, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """u, pos, rank: the rows of combined() for some vertices (v), by a search from each over the l instances. Where
    they are few, all vertices' sketches need not be grown. ranks (v, i, rank) are read once."""
    found = reach(live, vertices.select(F.col("v").alias("q"), "v").distinct(), l, strategy=strategy)
    return _smallest(found.join(ranks, ["i", "v"]).select(F.col("q").alias("u"), "rank"), ["u"], k).select("u", "pos", "rank")


def build(graph, model: str, k: int, l: int, seed: int, p: float = 0.1, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """The combined sketches of a graph's vertices; write them out as the index that estimates are made from."""
    from cascadia.operators.live import live_edges
    from cascadia.operators.ranks import full

    if k < 2:
        raise ValueError("k is 2 at least")
    live = settle(live_edges(graph, model, l, seed, p), "live")
    ranks = settle(full(graph.arcs.sparkSession, graph.n, l), "ranks")
    return combined(lists(live, ranks, k, strategy), k)


def sizes(sketches: DataFrame) -> DataFrame:
    """One row: entries and bytes (8 an entry)."""
    return sketches.agg(F.count("*").alias("entries"), (F.count("*") * 8).alias("bytes"))


def _taus(sketches: DataFrame, pairs: int, k: int) -> DataFrame:
    return sketches.groupBy("u").agg(F.when(F.count("*") >= k, F.max("rank")).otherwise(F.lit(pairs)).cast("long").alias("tau"), (F.count("*") >= k).alias("full"))


def estimate_all(sketches: DataFrame, n: int, k: int, l: int) -> DataFrame:  # noqa: E741
    """u, estimate: the influence of every single vertex, in one aggregation."""
    count = F.count("*")
    return sketches.groupBy("u").agg(F.when(count >= k, F.lit(k - 1) * n / F.max("rank")).otherwise(count / F.lit(l)).alias("estimate"))


def estimate(sketches: DataFrame, seeds: DataFrame, n: int, k: int, l: int) -> DataFrame:  # noqa: E741
    """q, estimate: the influence of seed sets (q, v), all in one job. A rank in several members' sketches counts with
    its largest threshold; full sketches leave out their last rank. Repeated seeds do not matter."""
    own = seeds.select("q", F.col("v").alias("u")).distinct()
    sketches = sketches.join(own.select("u").distinct(), "u", "left_semi")
    taus = _taus(sketches, n * l, k)
    items = own.join(sketches, "u").join(taus, "u").where(~F.col("full") | (F.col("rank") < F.col("tau")))
    best = items.groupBy("q", "rank").agg(F.max("tau").alias("tau"))
    return best.groupBy("q").agg((n * F.sum(1 / F.col("tau"))).alias("estimate"))
