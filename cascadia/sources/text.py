"""Graphs from METIS and DIMACS text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cascadia.functions.prefix import prefix
from cascadia.functions.tables import settle
from cascadia.operators.graph import Graph


def metis(spark: SparkSession, path: str, **options) -> Graph:
    """A METIS file, or a folder of parts that follow each other by name: % lines are comments; the first line that is not empty holds the number of vertices; the j-th
    line after it lists the heads of vertex j's arcs, from 1; an empty line is a vertex without arcs.

    Lines are numbered by their file, their block of it and their place there, without one task for all. Weighted
    formats raise. options go to Graph.from_arcs."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), place, F.monotonically_increasing_id().alias("at"))
    lines = settle(lines, "lines").where(~F.ltrim("line").startswith("%"))
    numbered = settle(prefix(lines, [], F.col("block"), ["at"], "no").drop("block"), "numbered")
    head = numbered.where(F.trim("line") != "").orderBy("no").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    fields = head["line"].split()
    if len(fields) > 2 and fields[2].strip("0"):
        raise ValueError(f"{path} is a weighted METIS file (format {fields[2]})")
    n = int(fields[0])
    data = numbered.where((F.col("no") > head["no"]) & (F.col("no") <= head["no"] + n))
    arcs = data.select((F.col("no") - head["no"]).alias("src"), F.explode(F.split(F.trim("line"), r"\s+")).alias("dst")).where("dst <> ''").select("src", F.col("dst").cast("long").alias("dst"))
    return Graph.from_arcs(arcs, n=n, one_based=True, **options).validated()


def dimacs(spark: SparkSession, path: str, **options) -> Graph:
    """A DIMACS file: c and % lines are comments, `p <kind> n m` is the header, `a u v [w]` an arc from u to v, from 1;
    the weight is not used. options go to Graph.from_arcs."""
    fields = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "\r$", "")), r"\s+").alias("f"))
    head = fields.where(F.col("f")[0] == "p").first()
    if head is None:
        raise ValueError(f"{path} has no p line")
    arcs = fields.where(F.col("f")[0] == "a").select(F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"))
    return Graph.from_arcs(arcs, n=int(head["f"][2]), one_based=True, **options).validated()


def write_metis(graph: Graph, path: str) -> None:
    """The graph as METIS text, in order: a folder with one part for each range of vertices, whose names follow each
    other; the header is the first line of the first."""
    spark = graph.arcs.sparkSession
    heads = graph.arcs.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    lines = graph.vertices().join(heads, F.col("v") == F.col("src"), "left").select("v", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(-1, f"{graph.n} {graph.arcs.count()}")], "v long, value string")
    lines.unionByName(head).repartitionByRange("v").sortWithinPartitions("v").select("value").write.text(path)


def write_dimacs(graph: Graph, path: str) -> None:
    """The graph as DIMACS text with weights of 1."""
    arcs = graph.arcs.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, F.lit(1)).alias("value"))
    head = graph.arcs.sparkSession.createDataFrame([(f"p sp {graph.n} {graph.arcs.count()}",)], "value string")
    head.unionByName(arcs).write.text(path)


def arcs_table(graph: Graph, path: str) -> None:
    """The graph's arcs as Parquet, clustered by tail."""
    graph.arcs.repartitionByRange("src").write.parquet(path)


def read_arcs(spark: SparkSession, path: str, **options) -> Graph:
    """A graph from a Parquet table of arcs."""
    return Graph.from_arcs(spark.read.parquet(path), **options)

