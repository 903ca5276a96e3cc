"""Running sums over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str, weight: Column | None = None) -> DataFrame:
    """Adds out: the sum of weight (1 if not given) over the rows of the same keys that come before in the order
    (bucket, *order). The bucket, never null, deals a large group out over many tasks: only sums by bucket, of which
    there are as many as the caller's bucket expression has values, pass through one window per group.

    Null keys form a group; ties in the order are broken as Spark meets them. df is read twice.
    """
    # structs, unlike the keys themselves, are never null, so that plain equality joins them and the window's
    # partitioning and order serve the join too; its sums must not make Spark broadcast the rows
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns({"_b": bucket, "_w": weight if weight is not None else F.lit(1).cast("long")} | {n: F.struct(F.col(k)) for n, k in zip(names, keys, strict=True)})
    sums = df.groupBy(*names, "_b").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*names, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_l", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    return local.join(sums.hint("merge"), [*names, "_b"]).withColumn(out, (F.col("_base") + F.col("_l")).cast("long")).drop("_b", "_w", "_l", "_base", *names)
