"""Graphs as DataFrames of arcs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """arcs (src, dst: long, vertices 0 to n - 1). Undirected graphs hold every edge in both directions, hashed apart."""

    arcs: DataFrame
    n: int
    directed: bool = True

    @staticmethod
    def from_arcs(df: DataFrame, n: int | None = None, directed: bool = True, transpose: bool = False, drop_parallel: bool = False, symmetrize: bool = False, self_loops: bool = False, one_based: bool = False) -> Graph:
        """df's first two columns are tails and heads.

        Undirected: arcs from the smaller to the larger end count and are mirrored, so the input must list both
        directions; symmetrize takes any direction instead and drops parallel edges. n: the largest id plus 1 if not
        given. Parallel arcs stay (they add to in-degrees) unless drop_parallel.
        """
        shift = 1 if one_based else 0
        arcs = df.select((df[0].cast("long") - shift).alias("src"), (df[1].cast("long") - shift).alias("dst"))
        if not self_loops:
            arcs = arcs.where("src <> dst")
        if transpose:
            arcs = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if symmetrize:
            arcs = arcs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
            directed = False
        elif not directed:
            arcs = arcs.where("src <= dst")
        if drop_parallel:
            arcs = arcs.dropDuplicates(["src", "dst"])
        if not directed:
            arcs = arcs.unionByName(arcs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if n is None:
            top = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n = 0 if top is None else top + 1
        return Graph(arcs, n, directed)

    @staticmethod
    def dense(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(arcs with dense ids, ids): any two long columns re-indexed by ascending key."""
        from cascadia.functions.prefix import prefix

        keys = df.select(df[0].alias("key")).union(df.select(df[1].alias("key"))).distinct()
        lo, hi = keys.agg(F.min("key"), F.max("key")).first()
        width = max(1, ((hi or 0) - (lo or 0)) // 4096 + 1)
        ids = prefix(keys, [], F.floor((F.col("key") - (lo or 0)) / width), ["key"], "id")
        arcs = df.select(df[0].alias("a"), df[1].alias("b")).join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b")
        return arcs.select("src", "dst"), ids

    def transposed(self) -> Graph:
        return Graph(self.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.n, self.directed)

    def vertices(self) -> DataFrame:
        return self.arcs.sparkSession.range(self.n).withColumnRenamed("id", "v")

    def in_degrees(self) -> DataFrame:
        """dst, indeg; parallel arcs count."""
        return self.arcs.groupBy("dst").agg(F.count("*").alias("indeg"))

    def out_degrees(self) -> DataFrame:
        """src, outdeg; parallel arcs count."""
        return self.arcs.groupBy("src").agg(F.count("*").alias("outdeg"))

    def statistics(self) -> DataFrame:
        """One row: n, arcs, self_loops, out_of_range, parallel (arcs beyond the first of a pair)."""
        return self.arcs.groupBy("src", "dst").agg(F.count("*").alias("m")).agg(
            F.lit(self.n).cast("long").alias("n"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("arcs"),
            F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("m"))), F.lit(0)).alias("self_loops"),
            F.coalesce(F.sum(F.when((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= self.n), F.col("m"))), F.lit(0)).alias("out_of_range"),
            F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("parallel"),
        )

    def validated(self) -> Graph:
        """The graph itself; raises if an arc's end is out of range."""
        bad = self.statistics().first()["out_of_range"]
        if bad:
            raise ValueError(f"{bad} arcs have an end outside 0 to {self.n - 1}")
        return self
