"""Random but repeatable orders of vertex-instance pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.functions.hashing import hashed
from cascadia.functions.prefix import prefix

RANK_SEED = 7


def _band():
    """4096 stretches of hash values."""
    return F.shiftright("h", 20)


def _pairs(spark, n: int, l: int) -> DataFrame:  # noqa: E741
    return spark.range(n).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(l - 1))).alias("i"))


def full(spark, n: int, l: int, seed: int = RANK_SEED) -> DataFrame:  # noqa: E741
    """v, i, rank: a permutation of all n * l pairs, ranks from 0, in the order of a hash."""
    pairs = hashed(_pairs(spark, n, l).withColumn("zero", F.lit(0)), "v", "i", "zero", l, seed)
    return prefix(pairs, [], _band(), ["h", "v", "i"], "rank").select("v", "i", "rank")


def stratified(spark, n: int, l: int, seed: int = RANK_SEED) -> DataFrame:  # noqa: E741
    """v, i, round, rank: every round has each vertex once, in a new order, with an instance it has not had."""
    pairs = hashed(_pairs(spark, n, l).withColumn("one", F.lit(1)), "v", "i", "one", l, seed)
    pairs = pairs.withColumn("round", F.row_number().over(Window.partitionBy("v").orderBy("h", "i"))).drop("h", "one")
    pairs = hashed(pairs.withColumn("two", F.lit(2)), "v", "round", "two", l, seed)
    placed = prefix(pairs.select("v", "i", "round", "h"), ["round"], _band(), ["h", "v"], "pos")
    return placed.select("v", "i", "round", ((F.col("round") - 1) * F.lit(n).cast("long") + F.col("pos")).alias("rank"))


def identity(spark, n: int) -> DataFrame:
    """id, value: the identity permutation."""
    return spark.range(n).select("id", F.col("id").alias("value"))


def inverse(permutation: DataFrame) -> DataFrame:
    """id and value swapped."""
    return permutation.select(F.col("value").alias("id"), F.col("id").alias("value"))


def weighted(weights: DataFrame, seed: int = RANK_SEED) -> DataFrame:
    """id, value (its place): a draw without replacement by weight (id, weight); weights of 0 come last."""
    drawn = hashed(weights.withColumn("zero", F.lit(0)), "id", "zero", "zero", 1, seed)
    key = F.when(F.col("weight") > 0, -F.log((F.col("h") + 1) / F.lit(2.0**32)) / F.col("weight")).otherwise(F.lit(float("inf")))
    band = F.when(F.col("key") < 2.0**40, F.floor(F.log2(F.col("key") + 2.0**-40) * 64)).otherwise(1 << 20).cast("long")
    return prefix(drawn.withColumn("key", key), [], band, ["key", "h", "id"], "value").select("id", "value")


def is_permutation(permutation: DataFrame, n: int) -> bool:
    """Whether the values are 0 to n - 1, each once."""
    r = permutation.agg(F.count("*"), F.countDistinct("value"), F.min("value"), F.max("value")).first()
    return tuple(r) == (n, n, 0, n - 1) if n else r[0] == 0
