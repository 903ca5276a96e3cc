"""Seed sets drawn at random, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.functions.hashing import hashed
from cascadia.functions.prefix import prefix
from cascadia.functions.tables import settle
from cascadia.operators.graph import Graph

SAMPLE_SEED = 11


def parse_ranges(spec: str) -> list[int]:
    """"10-12,1,5" as sorted distinct numbers; spaces do not matter."""
    out: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        lo, _, hi = part.partition("-")
        out.update(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


def ranges(spark, spec: str) -> DataFrame:
    """The numbers of a range specification: value."""
    parts = spark.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", r"\s*,\s*")).alias("part")).where("part <> ''")
    ends = parts.select(F.split("part", r"\s*-\s*").alias("e"))
    return ends.select(F.explode(F.sequence(F.element_at("e", 1).cast("int"), F.element_at("e", -1).cast("int"))).alias("value")).distinct().orderBy("value")


def _queries(spark, sizes: list[int], queries: int) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sizes], "size int").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))


def uniform(spark, n: int, sizes: list[int], queries: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """size, q, slot, v: for each size as many sets of that many vertices, with replacement."""
    slots = _queries(spark, sizes, queries).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return hashed(slots, "size", "q", "slot", 1, seed).select("size", "q", "slot", F.pmod("h", F.lit(n)).alias("v"))


def neighborhood(graph: Graph, sizes: list[int], queries: int, seed: int = SAMPLE_SEED, attempts: int = 64) -> DataFrame:
    """size, q, slot, v: sets from balls around random places. A place is the tail of a random arc; its ball grows by
    whole levels over all arcs until it has the vertices that are missing, of which as many are drawn without
    replacement; a ball that ends before gives all it has and another place follows. All queries advance together."""
    spark = graph.arcs.sparkSession
    numbered = settle(prefix(graph.arcs.withColumn("b", F.pmod(F.xxhash64("src", "dst"), F.lit(1024))), [], F.col("b"), ["src", "dst"], "no").select("no", "src"), "arcs")
    m = numbered.count()
    arcs = graph.arcs.select("src", "dst").distinct()
    have = spark.createDataFrame([], "size int, q int, v long")
    for attempt in range(attempts if m else 0):
        done = have.groupBy("size", "q").agg(F.count("*").alias("got"))
        open_sets = _queries(spark, sizes, queries).join(done, ["size", "q"], "left").withColumn("need", F.col("size") - F.coalesce("got", F.lit(0))).where("need > 0")
        open_sets = settle(hashed(open_sets.withColumn("try", F.lit(attempt)), "size", "q", "try", 3, seed).select("size", "q", "need", F.pmod("h", F.lit(m)).alias("no")), "open")
        if open_sets.isEmpty():
            break
        front = settle(open_sets.join(numbered, "no").select("size", "q", "need", F.col("src").alias("v")), "ball")
        ball = front.select("size", "q", "v")
        while True:
            fresh_count = ball.join(have, ["size", "q", "v"], "left_anti").groupBy("size", "q").agg(F.count("*").alias("c"))
            go_on = front.join(fresh_count, ["size", "q"], "left").where(F.coalesce("c", F.lit(0)) < F.col("need")).drop("c")
            step = go_on.withColumnRenamed("v", "src").join(arcs, "src").select("size", "q", "need", F.col("dst").alias("v")).distinct()
            front = settle(step.join(ball, ["size", "q", "v"], "left_anti").select("size", "q", "need", "v"), "ball")
            if front.isEmpty():
                break
            ball = settle(ball.unionByName(front.select("size", "q", "v")), "ball")
        fresh = hashed(ball.join(have, ["size", "q", "v"], "left_anti"), "size", "q", "v", 5, seed)
        place = F.row_number().over(Window.partitionBy("size", "q").orderBy("h", "v"))
        drawn = fresh.withColumn("p", place).join(open_sets, ["size", "q"]).where("p <= need").select("size", "q", "v")
        have = settle(have.unionByName(drawn), "sets")
    slot = F.row_number().over(Window.partitionBy("size", "q").orderBy("v")) - 1
    return have.select("size", "q", slot.alias("slot"), "v")
