"""Pipeline stages: documents in, documents out, but for the last.

Columns other than the five that stages use have any names and types; they go through as they are.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from cascadia.llm import mixing, packing, set_join, substrings, toxicity
from cascadia.llm.store import shards, stage, table

#: The pipeline's near copies: so many per cent of their shingles of so many words are the same.
WORDS, PERCENT = 5, 80


def _apart(run):
    """A stage for which all columns that it doesn't use have names of their own, so that none clashes with its."""

    @wraps(run)
    def stage_of(spark, docs, sf_dir, *more):
        names = docs.columns
        inner = [c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"_column_{i}" for i, c in enumerate(names)]
        out = run(spark, docs.toDF(*inner), sf_dir, *more)
        return out.toDF(*names) if out.columns == inner else out

    return stage_of


@_apart
def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score stays under their language's threshold.

    Rows are judged one by one: repeated ones go or stay together; null and empty texts have no words and score as
    such; a null language has a threshold of its own; doc_ids play no part beyond the labels' join."""
    with stage(spark):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return toxicity.score(docs, model).where(~F.col("flagged")).select(*docs.columns)


@_apart
def one_of_each(spark, docs, sf_dir, k=WORDS, percent=PERCENT):
    """Of each group of linked documents the row with the smallest doc_id (null last); of equal rows one. Rows without
    words are no copies: of those only equal texts under one doc_id, not null, leave one. Null texts have no words.
    Of other rows under one doc_id each stands for itself. An empty table gives no rows."""
    with stage(spark):
        worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
        rows = docs.withColumn("_worded", worded)
        for i, c in enumerate(("_a", "_b")):  # 128 bits that equal rows share
            rows = rows.withColumn(c, F.when(F.col("_worded"), F.xxhash64(F.lit(i), *docs.columns)).otherwise(F.xxhash64(F.lit(i), "doc_id", "text")))
        # the join orders rows by this in place of the doc_id, so that every row has a name of its own
        named = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_a").alias("a"), F.col("_b").alias("b"))
        found = set_join.join(rows.select(named.alias("doc_id"), "text"), k, percent)
        gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id.a").alias("_a"), F.col("doc_id.b").alias("_b")).distinct()
        kept = rows.join(gone, ["_a", "_b"], "left_anti")
        same = rows.where("_worded or doc_id is not null")
        if not same.groupBy("_a", "_b").count().where("count > 1").isEmpty():
            own = F.when(F.col("_worded") | F.col("doc_id").isNotNull(), -1).otherwise(F.monotonically_increasing_id())
            kept = kept.withColumn("_own", own).dropDuplicates(["_a", "_b", "_own"])
        return kept.select(*docs.columns)


def without_near_copies(spark, docs, sf_dir):
    """One document of each group that links by five words and a similarity of 0.8 connect; see one_of_each."""
    return one_of_each(spark, docs, sf_dir, WORDS, PERCENT)


@_apart
def without_repeats(spark, docs, sf_dir):
    """Documents without words that earlier ones have in passages of 13 words or more; those left empty by that go.
    Texts that lose nothing, null and empty ones among them, stay as they are; the words left of others are joined by
    single spaces. Rows with one doc_id do not shorten each other; a null doc_id counts as the largest. An empty table
    gives no rows."""
    with stage(spark):

        def make(text, words, kept):
            whole = len(kept) == len(words)
            left = text if whole else b" ".join(kept).decode()
            return left, (whole or bool(kept))

        out = substrings.with_kept(docs, substrings.repeats(docs), make, "_left string, _stays boolean", ["_left", "_stays"])
        out = out.where("_stays").withColumn("text", F.col("_left"))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
        return out.select(*docs.columns)


@_apart
def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them; a last copy of which it takes the first words only has those. Rows
    are in the order of the schedule: a copy stands where the block starts that has its first word.

    Null and empty texts have no words and are not taken. A null source is a source. Equal rows and rows with one
    doc_id, null too, are documents of their own. An empty table gives no rows."""
    with stage(spark):
        # rows of one name are equal, so that any of them stands for all
        rows = docs.withColumn("_one", F.xxhash64(F.lit(0), *docs.columns)).withColumn("_two", F.xxhash64(F.lit(1), *docs.columns))
        found, slots = mixing.mix(rows, ("_one", "_two"))
        found = table(found.where("taken > 0").select("_one", "_two", "taken", "size", "s", "at", "first_block"), "mix-taken")
        slots = slots.select("s", "turn", F.col("block_no").alias("first_block"), "j")
        if not found.groupBy("_one", "_two").count().where("count > 1").isEmpty():
            rows = rows.dropDuplicates(["_one", "_two"])
        full, part = F.floor(F.col("taken") / F.col("size")), (F.col("taken") % F.col("size")).cast("int")
        turns = full + F.when(part > 0, 1).otherwise(0)
        copies = found.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1))).withColumn("_words", F.when(F.col("turn") >= full, part))
        copies = copies.join(slots.hint("merge"), ["s", "turn", "first_block"], "left").select("_one", "_two", "_words", F.coalesce("j", F.lit(0)).alias("_slot"), "at")
        parts, last = shards(spark), slots.agg(F.max("j")).first()[0] or 0
        out = rows.join(copies.hint("merge"), ["_one", "_two"])
        words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1)), F.lit(1), F.col("_words")), " ")
        out = out.withColumn("text", F.when(F.col("_words").isNotNull(), words).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col("_words").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
        # blocks have equal lengths, so equal stretches of slots have about as many words
        out = out.repartitionById(parts, F.floor(F.col("_slot") * parts / (last + 1)).cast("int")).sortWithinPartitions("_slot", "at")
        return out.select(*docs.columns)


@_apart
def packed(spark, docs, sf_dir):
    """Documents packed into sequences of at most 1024 tokens.

    A null or empty text is its end token. Equal rows and rows with one doc_id, null too, are packed each. An empty
    table gives no rows."""
    with stage(spark):
        return packing.pack(docs)
