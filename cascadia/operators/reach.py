"""Reachability over live arcs.

Two strategies with one result. "rounds": all queries and instances advance by one arc in each job; state is a table.
"worlds": an instance's arcs go to tasks that search there for some of the queries and hand on what they find in
batches, or counts alone; chosen where the largest instance's arcs and the largest query are counted to be at most
LOCAL. A task holds the arcs and one search, however much its queries find together.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.functions.tables import settle

#: Arcs of an instance in a task, queries that share a copy of them, pairs handed on at once, tasks of a job.
LOCAL, QUERIES, STEP, TASKS = 2_000_000, 1 << 17, 1 << 18, 4096


def largest(df: DataFrame) -> int:
    """Rows of the instance that has most."""
    return df.groupBy("i").count().agg(F.max("count")).first()[0] or 0


def gather(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[np.ndarray]]:
    """The instance of a group of worlds(), and its tails, heads, queries and sources."""
    i, parts = 0, [[np.empty(0, np.int64)] for _ in range(4)]
    for b in batches:
        if b.num_rows:
            i = b.column("i")[0].as_py()
            arc, one, two = (b.column(c).to_numpy(zero_copy_only=False) for c in ("arc", "one", "two"))
            for part, x in zip(parts, (one[arc], two[arc], one[~arc], two[~arc]), strict=True):
                part.append(x)
    return i, [np.concatenate(x) for x in parts]


def neighbours(src: np.ndarray, dst: np.ndarray, n: int) -> list:
    """The heads of each of n tails."""
    order = np.argsort(src, kind="stable")
    tails, first = np.unique(src[order], return_index=True)
    heads, first, out = dst[order].tolist(), [*first.tolist(), len(src)], [()] * n
    for tail, low, high in zip(tails.tolist(), first, first[1:], strict=False):
        out[tail] = heads[low:high]
    return out


def worlds(live: DataFrame, own: DataFrame, run, schema: str, l: int, parts: int = 1) -> DataFrame:  # noqa: E741
    """run over the batches of each instance's arcs (live) with a part of its rows own (q, i, v), a task for each."""
    arcs = live.select("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("arc"), F.col("src").alias("one"), F.col("dst").alias("two"))
    rest = own.select("i", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("arc"), F.col("q").cast("long").alias("one"), F.col("v").alias("two"))
    rows = arcs.unionByName(rest).withColumn("slot", (F.col("i") * parts + F.col("part")).cast("int"))
    n = min(TASKS, l * parts)
    return rows.repartitionById(n, F.pmod("slot", F.lit(n))).groupBy("slot").applyInArrow(run, schema)


def _searcher(how: str):
    """A search for "pairs" (q, i, v), for "sizes" (q, i, size) of what each query reaches, or for what each reaches
    "first" (q, i, size), queries taken in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, (src, dst, q, v) = gather(batches)
        if not len(q):
            return
        ids, dense = np.unique(np.concatenate([src, dst, v]), return_inverse=True)
        m = len(src)
        out = neighbours(dense[:m], dense[m : 2 * m], len(ids))
        order = np.argsort(q, kind="stable")
        names, first = np.unique(q[order], return_index=True)
        starts, first = dense[2 * m :][order].tolist(), [*first.tolist(), len(q)]
        del src, dst, q, v, dense, order
        mark, found, sizes, done = [-1] * len(ids), [], [], 0

        def batch(upto: int) -> pa.RecordBatch:
            own, count = names[done:upto], np.array(sizes, np.int64)
            if how == "pairs":
                own, count = np.repeat(own, count), ids[np.array(found, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), i, np.int32)), pa.array(count)], names=["q", "i", "v" if how == "pairs" else "size"])

        for at, (low, high) in enumerate(zip(first, first[1:], strict=False)):
            no = 0 if how == "first" else at
            seen = []
            for x in starts[low:high]:
                if mark[x] != no:
                    mark[x] = no
                    seen.append(x)
            for x in seen:
                for y in out[x]:
                    if mark[y] != no:
                        mark[y] = no
                        seen.append(y)
            sizes.append(len(seen))
            if how == "pairs":
                found += seen
            if max(len(found), len(sizes)) >= STEP:
                yield batch(at + 1)
                found, sizes, done = [], [], at + 1
        if sizes:
            yield batch(len(names))

    return run


def search(live: DataFrame, starts: DataFrame, l: int, how: str = "pairs", queries: int = 0) -> DataFrame:  # noqa: E741
    """What starts (q, i, v) reach in instances of at most LOCAL arcs. queries: how many an instance has at most."""
    parts = 1 if how == "first" else max(1, -(-queries // QUERIES))
    return worlds(live, starts, _searcher(how), "q long, i int, v long" if how == "pairs" else "q long, i int, size long", l, parts)


def _starts(live: DataFrame, sources: DataFrame, l: int, covered: DataFrame | None) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    starts = sources.select("q", "v").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(l - 1))))
    if covered is not None:
        starts = starts.join(covered, ["i", "v"], "left_anti")
        live = live.join(covered.withColumnRenamed("v", "dst"), ["i", "dst"], "left_anti").select("i", "src", "dst")
    return live, starts


def _parts(live: DataFrame, sources: DataFrame, strategy: str) -> int:
    """The queries that a task would share at most, for search(); 0 where rounds are to be taken."""
    if strategy == "rounds":
        return 0
    r = sources.groupBy("q").count().agg(F.count("*").alias("queries"), F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if strategy == "auto" and max(r["most"] or 0, largest(live)) > LOCAL:
        return 0
    return max(1, r["queries"], -(-(r["rows"] or 0) * QUERIES // LOCAL))


def reach(live: DataFrame, sources: DataFrame, l: int, covered: DataFrame | None = None, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """q, i, v: what each query reaches in each of l instances, its sources included. sources: q, v.

    covered (i, v): pairs that are neither entered nor passed. Repeated sources do not matter.
    """
    queries = _parts(live, sources, strategy)
    live, starts = _starts(live, sources, l, covered)
    if queries:
        return search(live, starts, l, "pairs", queries)
    front = seen = settle(starts.select("q", "i", "v"), "reach")
    parts = [seen]
    while True:
        step = front.withColumnRenamed("v", "src").join(live, ["i", "src"]).select("q", "i", F.col("dst").alias("v")).distinct()
        front = settle(step.join(seen, ["q", "i", "v"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        parts.append(front)
        if len(parts) > 16:
            parts = [settle(seen.unionByName(front), "reach")]
        seen = parts[0]
        for x in parts[1:]:
            seen = seen.unionByName(x)


def sizes(live: DataFrame, sources: DataFrame, l: int, covered: DataFrame | None = None, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """q, i, size: how many vertices reach() finds; counted where they are found, the pairs go nowhere."""
    if queries := _parts(live, sources, strategy):
        return search(*_starts(live, sources, l, covered), l, "sizes", queries)
    return reach(live, sources, l, covered, "rounds").groupBy("q", "i").agg(F.count("*").alias("size"))


def firsts(live: DataFrame, sources: DataFrame, l: int, strategy: str = "auto") -> DataFrame:  # noqa: E741
    """q, i, size: how many vertices a query reaches that none with a smaller q does; no row may stand for none. A
    vertex is passed once for all queries."""
    if strategy != "rounds" and (strategy == "worlds" or max(largest(live), sources.count()) <= LOCAL):
        return search(*_starts(live, sources, l, None), l, "first")
    found = reach(live, sources, l, strategy="rounds")
    return found.groupBy("i", "v").agg(F.min("q").alias("q")).groupBy("q", "i").agg(F.count("*").alias("size"))


def pack(live: DataFrame) -> DataFrame:
    """i, src, dst: an instance's arcs in one row, as bytes of longs in order of tails, for spread().
    Only for instances of at most LOCAL arcs."""

    def run(t: pa.Table) -> pa.Table:
        src, dst = t.column("src").to_numpy(), t.column("dst").to_numpy()
        order = np.argsort(src, kind="stable")
        return pa.table({"i": t.column("i")[:1], "src": pa.array([src[order].tobytes()], pa.binary()), "dst": pa.array([dst[order].tobytes()], pa.binary())})

    return live.groupBy("i").applyInArrow(run, "i int, src binary, dst binary")


def spread(packed: DataFrame, u: int, l: int) -> DataFrame:  # noqa: E741
    """i, v: what one vertex reaches in each of l packed instances, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, src, dst in zip(*(b.column(c).to_pylist() for c in ("i", "src", "dst")), strict=True):
                src, dst = np.frombuffer(src, np.int64), np.frombuffer(dst, np.int64)
                seen = edge = np.array([u], np.int64)
                while len(edge):
                    first, count = np.searchsorted(src, edge), np.searchsorted(src, edge, "right") - np.searchsorted(src, edge)
                    at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
                    edge = np.setdiff1d(dst[at], seen)
                    seen = np.union1d(seen, edge)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i, np.int32)), pa.array(seen)], names=["i", "v"])

    own = packed.sparkSession.range(l).select(F.col("id").cast("int").alias("i"), F.lit(u).cast("long").alias("v"))
    return packed.mapInArrow(run, "i int, v long").unionByName(own).distinct()


def most(out: list) -> np.ndarray:
    """For each tail of neighbours() a number that what it reaches, itself included, does not exceed: its strongly
    connected component's size and the sums of the components right after it, so that it counts paths to them."""
    n = len(out)
    seen, low, own = (array("q", [x]) * n for x in (0, 0, -1))  # far smaller than lists
    sums, path, clock = array("q"), [], 0
    for root in range(n):
        todo = [] if seen[root] else [root]
        while todo:
            x = todo[-1]
            if not seen[x]:
                clock += 1
                seen[x] = low[x] = clock
                path.append(x)
                if more := [y for y in out[x] if not seen[y]]:
                    todo += more
                    continue
            todo.pop()
            if own[x] >= 0:  # passed from elsewhere meanwhile
                continue
            for y in out[x]:
                if own[y] < 0 and low[y] < low[x]:
                    low[x] = low[y]
            if low[x] == seen[x]:
                members = []
                while own[x] < 0:
                    members.append(y := path.pop())
                    own[y] = len(sums)
                after = {own[y] for m in members for y in out[m]} - {len(sums)}
                sums.append(min(n, len(members) + sum(sums[c] for c in after)))
    return np.array(sums, np.int64)[np.array(own, np.int64)]


def bounds(packed: DataFrame, l: int) -> DataFrame:  # noqa: E741
    """u, size: what a vertex reaches in l packed instances together is size at most. Only of vertices with arcs of
    their own, all others reach l."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(b.column("src"), b.column("dst"), strict=True):
                src, dst = (np.frombuffer(x.as_buffer(), np.int64) for x in row)
                ids, dense = np.unique(np.concatenate([src, dst]), return_inverse=True)
                more = most(neighbours(dense[: len(src)], dense[len(src) :], len(ids))) - 1
                some = np.flatnonzero(more)
                for low in range(0, len(some), STEP):
                    at = some[low : low + STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(more[at])], names=["u", "more"])

    return packed.select("src", "dst").mapInArrow(run, "u long, more long").groupBy("u").agg((F.sum("more") + F.lit(l)).alias("size"))


def levels(arcs: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """q, v, level: the ball around each query's sources over all arcs, level by level, up to depth."""
    front = settle(sources.select("q", "v").distinct().withColumn("level", F.lit(0)), "ball")
    seen = front
    for level in range(1, depth + 1):
        step = front.select("q", F.col("v").alias("src")).join(arcs, "src").select("q", F.col("dst").alias("v")).distinct()
        front = settle(step.join(seen, ["q", "v"], "left_anti").withColumn("level", F.lit(level)), "ball")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
