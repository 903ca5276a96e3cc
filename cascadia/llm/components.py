"""Connected components of a link table, by local contraction and alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.llm.store import let_go, table


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links to a spanning forest in which every node points to the smallest of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    u = np.fromiter(up, np.int64, len(up))
    v = np.fromiter((root(x) for x in up), np.int64, len(up))
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links (u, v: long). Nodes without links are not
    in the result. Directions, repeats and loops do not matter; null ends are ignored.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each one aggregation and one join, until the
    links no longer change; every round is written to the shared folder.
    """
    e = table(links.where("u <> v").mapInArrow(_forest, "u long, v long"), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        joined = low.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = table(small, "links")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    let_go(links.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
