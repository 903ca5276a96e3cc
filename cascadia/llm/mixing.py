"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, in a pseudo-random order, are one stream of words cut into blocks of equal length. Points of the
golden-ratio sequence fall on the sources' cumulative shares; a source's r-th point is its slot r and takes block
r mod (its number of blocks), so that any stretch of the schedule has the sources near their shares. A source's slots
end where its target is reached, the last one within its block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.functions.prefix import prefix
from cascadia.llm.store import table

#: Blocks of the whole mix, about; bounds the schedule whatever the input.
SLOTS = 1 << 17
#: The golden ratio's fraction in units of 2 ** -32.
GOLDEN = 2654435769
#: Bits of a cell of slots.
CELL = 6
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words (null text: 0), mixed: 32 bits of a hash of the doc_id, text; and other columns."""
    mixed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mixed.alias("mixed"), *also)


def targets(rows: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Per source: s (from 0, by code point, null last), source_size, target, words (target, whole), and block, the
    length of a block. Weighs sources 1 to cycle, repeating; a target stops at most times its source's size and the
    excess is shared anew by weight. One row per source passes through a single window."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", F.col("s") % cycle + 1)
    everything = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("level", "s").rowsBetween(Window.unboundedPreceding, -1)
    # sources are full in the order of cap / weight: the water level if just those before this one are
    by = by.withColumn("water", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))))
    # it rises up to the first source that is not full, and falls after it
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.max("water").over(everything) * F.col("weight")))
    return by.select("source", "s", "source_size", "target", F.floor("target").cast("long").alias("words"), F.greatest(F.lit(1), F.floor(F.col("total") / SLOTS)).cast("long").alias("block"))


def schedule(plan: DataFrame) -> DataFrame:
    """The slots of the mix: j, their order, s, turn (how often the source has been through before), block_no, and
    words, how many of the block's first words the slot takes."""
    n = plan.where("words > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    n = n.withColumn("slots", F.floor(F.col("words") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("words") % F.col("source_size")) / F.col("block")))
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("to", F.sum("slots").over(upto)).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    every = n.agg(F.max("all").alias("all"))
    # by the three-distance theorem three points for each slot leave no source short
    spots = every.select("all", F.explode(F.sequence(F.lit(0), F.floor(F.col("all") * 3 / 4096).cast("int"))).alias("chunk"))
    points = spots.repartition(F.col("chunk")).select("all", "chunk", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("i")).select("chunk", "all", (F.col("chunk").cast("long") * 4096 + F.col("i")).alias("j"))
    points = points.withColumn("spot", F.shiftright((F.col("j") * GOLDEN) % (1 << 32) * F.col("all"), 32))
    # points and sources meet in cells of the slots' line, so that many sources do not make a nested loop
    own = n.select("s", "slots", "blocks", "block", "words", "source_size", "to", (F.col("to") - F.col("slots")).alias("from"))
    own = own.withColumn("cell", F.explode(F.sequence(F.shiftright("from", CELL), F.shiftright(F.col("to") - 1, CELL))))
    points = points.withColumn("cell", F.shiftright("spot", CELL)).join(own.hint("merge"), "cell").where((F.col("spot") >= F.col("from")) & (F.col("spot") < F.col("to")))
    ranked = prefix(points.select("j", "chunk", "s", "slots", "blocks", "block", "words", "source_size"), ["s"], F.col("chunk"), ["j"], "r").where("r < slots")
    block_no = F.col("r") % F.col("blocks")
    whole = F.least(F.col("block"), F.col("source_size") - block_no * F.col("block"))
    last = F.col("words") % F.col("source_size") - block_no * F.col("block")
    turn = F.floor(F.col("r") / F.col("blocks"))
    ends = turn == F.floor(F.col("words") / F.col("source_size"))
    return ranked.select("j", "s", turn.alias("turn"), block_no.alias("block_no"), F.when(ends, F.least(whole, last)).otherwise(whole).cast("long").alias("words"))


def mix(docs: DataFrame, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). documents: doc_id, source, size, source_size, target and taken, the words that the mix
    takes of it, repeats counted; a document's words are taken in full rounds, but for one document of each source
    of which the last round takes the first words.

    A null or empty text has size 0 and is taken 0 times. A null source is a source, the last. Repeated doc_ids and
    rows are documents of their own. Sources without words have target 0. An empty table gives no rows.
    also: other columns of docs that documents have too; they settle the order of rows that else are equal. Documents
    with them also have s and first_block, the block in which they start: with turn, these lead to a copy's slot.
    """
    rows = table(sized(docs, also), "mix-rows")
    plan = table(targets(rows), "mix-plan")
    slots = table(schedule(plan), "mix-slots")
    rows = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")
    empty = rows.where("size = 0")
    placed = prefix(rows.where("size > 0"), ["s"], F.shiftright("mixed", 20), ["mixed", "doc_id", "size", *also], "at", F.col("size"))
    cut = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))))
    use = slots.select("s", "block_no", F.col("words").alias("upto"))
    start = F.col("block_no") * F.col("block")
    words = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), start + F.coalesce("upto", F.lit(0))) - F.greatest(F.col("at"), start))
    taken = cut.join(use.hint("merge"), ["s", "block_no"], "left").groupBy("doc_id", "source", "size", "source_size", "target", "s", "at", *also).agg(F.sum(words).cast("long").alias("taken"))
    names = ["doc_id", "source", "size", "source_size", "target"]
    more = [*also, "s", "at", "first_block"] if also else []
    taken = taken.join(plan.select("s", "block"), "s").withColumn("first_block", F.floor(F.col("at") / F.col("block"))) if also else taken
    none = F.lit(0).cast("long")
    empty = empty.withColumn("at", none).withColumn("first_block", none)
    return taken.select(*names, "taken", *more).unionByName(empty.select(*names, none.alias("taken"), *more)), slots


def op6_mixing(spark, sf_dir):
    """All documents with the words that the mix takes of them."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in SQL: with the slots of a source in order, the mix takes its stream's first words over and over.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS mixed
  FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM a),
c AS (SELECT *, s % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total, 3 * source_size / (s % 3 + 1) AS level FROM b),
d AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS water0
      FROM c WINDOW w AS (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, max(water0) OVER () AS water FROM d),
f AS (SELECT source, s, source_size, least(cap::DOUBLE, water * weight) AS target FROM e),
g AS (SELECT z.doc_id, z.size, f.source_size, f.target, floor(f.target)::BIGINT AS words,
             coalesce(sum(z.size) OVER (PARTITION BY f.s ORDER BY z.mixed, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM sized z JOIN f ON z.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - pos)) END::BIGINT AS taken
FROM g
"""
