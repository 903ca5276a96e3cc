"""Statistics of runs as DataFrames and as the text lines that file sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(df: DataFrame, prefix, names: dict[str, str], group: int, order: list[str]) -> DataFrame:
    """place, value: `key = value` lines of each row, in the order of group, the order columns and the names."""
    lines = F.array(*[F.struct(F.lit(i).alias("no"), F.concat(prefix, F.lit(f"{key} = "), F.col(c).cast("string")).alias("value")) for i, (key, c) in enumerate(names.items())])
    keys = [F.col(c).cast("long") for c in order] + [F.lit(-1).cast("long")] * (2 - len(order))
    return df.select(F.explode(lines).alias("x"), *(k.alias(f"k{i}") for i, k in enumerate(keys))).select(F.struct(F.lit(group).alias("group"), "k0", F.col("x.no").alias("no"), "k1").alias("place"), "x.value")


def _total(spark, names: dict[str, object]) -> DataFrame:
    lines = [(i, f"{key} = {value}") for i, (key, value) in enumerate(names.items())]
    return spark.createDataFrame(lines, "no int, value string").select(F.struct(F.lit(0).alias("group"), F.lit(-1).cast("long").alias("k0"), "no", F.lit(-1).cast("long").alias("k1")).alias("place"), "value")


# fixed values: the keys of the statistics
_SEED = {
    "MarginalEstimatedInfluence": "est", "CumulativeEstimatedInfluence": "cum_est", "MarginalExactInfluence": "exact",
    "CumulativeExactInfluence": "cum_exact", "VertexId": "v", "TotalElapsedMilliseconds": "total_ms",
    "SketchBuildingElapsedMilliseconds": "sketch_ms", "InfluenceComputationElapsedMilliseconds": "exact_ms",
}
_QUERY = {
    "VertexIds": "vertices", "EstimatedInfluence": "estimate", "ExactInfluence": "exact", "Error": "error",
    "EstimatorElapsedMilliseconds": "estimate_ms", "ExactElapsedMilliseconds": "exact_ms",
}
_AVERAGE = {
    "AverageEstimatedInfluence": "estimate", "AverageExactInfluence": "exact", "AverageError": "error",
    "AverageEstimatorElapsedMilliseconds": "estimate_ms", "AverageExactElapsedMilliseconds": "exact_ms",
}


def run_totals(seeds: DataFrame, n: int, arcs: int) -> dict[str, object]:
    """The totals of a maximisation's run by key. Ranks come as permutations of n vertices one after the other."""
    r = seeds.agg(F.count("*").alias("seeds"), F.sum("est").alias("est"), F.sum("exact").alias("exact"), F.max("sketch_ms").alias("sketch"), F.max("exact_ms").alias("influence"), F.max("ranks_used").alias("ranks")).first()
    est, exact, sketch, influence, ranks = (r[c] or 0 for c in ("est", "exact", "sketch", "influence", "ranks"))
    return {
        "NumberOfVertices": n, "NumberOfArcs": arcs, "TotalEstimatedInfluence": float(est), "TotalExactInfluence": float(exact),
        "TotalElapsedMilliseconds": float(sketch + influence), "SketchBuildingElapsedMilliseconds": float(sketch),
        "InfluenceComputationElapsedMilliseconds": float(influence), "NumberOfRanksUsed": ranks, "NumberOfSeedVertices": r["seeds"],
        "RankComputationMethod": "shuffle", "NumberOfPermutationsComputed": -(-ranks // max(1, n)),
    }


def seed_statistics(seeds: DataFrame, n: int, arcs: int) -> DataFrame:
    """`key = value` lines of a maximisation: the run's totals, then eight for each seed, counted from 0."""
    one = seeds.withColumn("total_ms", F.col("sketch_ms") + F.col("exact_ms")).withColumn("no", F.col("step") - 1)
    lines = _pairs(one, F.concat("no", F.lit("_")), _SEED, 1, ["no"])
    return _total(seeds.sparkSession, run_totals(seeds, n, arcs)).unionByName(lines).orderBy("place").select("value")


def query_statistics(queries: DataFrame, sizes: DataFrame, totals: dict[str, object]) -> DataFrame:
    """`key = value` lines of a benchmark (influence.benchmark with times): totals (vertices, arcs and so on, by key),
    then for each size, counted from 0 in ascending order, its number of seeds, its queries and their averages."""
    numbered = sizes.withColumn("at", F.row_number().over(Window.orderBy("size")) - 1)  # a row for each size asked for
    lines = _total(sizes.sparkSession, totals | {"NumberOfSeedSetSizes": sizes.count()})
    name = F.concat("at", F.lit("_"))
    own = queries.join(numbered.select("size", "at"), "size")
    body = _pairs(own, F.concat("at", F.lit("_"), "q", F.lit("_")), _QUERY, 1, ["at", "q"]).select(F.struct(F.col("place.k0").alias("at"), F.lit(1).alias("part"), F.col("place.k1").alias("q"), F.col("place.no").alias("no")).alias("place"), "value")
    head, tail = (_pairs(numbered, name, keys, 1, ["at"]).select(F.struct(F.col("place.k0").alias("at"), F.lit(part).alias("part"), F.lit(-1).cast("long").alias("q"), F.col("place.no").alias("no")).alias("place"), "value") for keys, part in (({"SeedSetSize": "size"}, 0), (_AVERAGE, 2)))
    first = lines.select(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).alias("part"), F.lit(-1).cast("long").alias("q"), F.col("place.no").alias("no")).alias("place"), "value")
    return first.unionByName(head).unionByName(body).unionByName(tail).orderBy("place").select("value")


def coverage(seeds: DataFrame, n: int) -> DataFrame:
    """Lines of a coverage file: n, the number of seeds and the total time in ms, then each vertex, the exact influence
    and the time up to it, tabs between them."""
    one = seeds.withColumn("total_ms", F.col("sketch_ms") + F.col("exact_ms"))
    body = one.select(F.col("step").cast("long").alias("no"), F.concat_ws("\t", "v", "cum_exact", "total_ms").alias("value"))
    first = F.array(F.lit(str(n)), F.col("c").cast("string"), F.coalesce("ms", F.lit(0.0)).cast("string"))
    head = one.agg(F.count("*").alias("c"), F.max("total_ms").alias("ms")).select(F.posexplode(first).alias("p", "value")).select((F.col("p") - 2).cast("long").alias("no"), "value")
    return head.unionByName(body).orderBy("no").select("value")


def summary(seeds: DataFrame, n: int, arcs: int, seed: int) -> list[str]:
    """What a maximisation prints at its end."""
    t = run_totals(seeds, n, arcs)
    est, exact = t["TotalEstimatedInfluence"], t["TotalExactInfluence"]
    share = lambda x: 100 * x / max(1, n)
    return [
        f"Number of vertices: {n}.", f"Number of arcs: {arcs}.", f"Random seed: {seed}.",
        f"Number of seed vertices computed: {t['NumberOfSeedVertices']}.", f"Number of ranks used: {t['NumberOfRanksUsed']}.",
        f"Permutations computed: {t['NumberOfPermutationsComputed']} (each of size: {n}).",
        f"Building sketches: {t['SketchBuildingElapsedMilliseconds'] / 1000} sec.",
        f"Computing influence: {t['InfluenceComputationElapsedMilliseconds'] / 1000} sec.",
        f"Total time: {t['TotalElapsedMilliseconds'] / 1000} sec.",
        f"Estimated spread of solution: {est} ({share(est)} %).", f"Exact spread of solution: {exact} ({share(exact)} %).",
        f"Quality gap: {100 * (1 - exact / est) if est else 0.0} %",
    ]


def influence_lines(estimates: DataFrame) -> DataFrame:
    """vertex and estimate, a tab between them."""
    return estimates.orderBy("u").select(F.concat_ws("\t", "u", "estimate").alias("value"))


def degree_histogram(degrees: DataFrame, column: str) -> DataFrame:
    """How many vertices have each degree."""
    return degrees.groupBy(column).agg(F.count("*").alias("vertices"))


def top(estimates: DataFrame, k: int) -> DataFrame:
    """The k vertices with the greatest estimates, with their places."""
    best = estimates.orderBy(F.desc("estimate"), "u").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("estimate"), "u")))
