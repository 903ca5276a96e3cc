"""From raw documents to packed training sequences.

Toxic documents go, near copies leave one of each group, repeated passages are cut out, the sources are mixed to their
weights and what is left is packed. Each stage works on all that its predecessor kept, written as Parquet and read
again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cascadia.llm import stages
from cascadia.llm.store import delete, shared_dir

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("n-gram Jaccard join", stages.without_near_copies),
    ("substring dedup", stages.without_repeats),
    ("mixing sources to target weights", stages.mixed),
    ("best-fit packing", stages.packed),
]

#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's rows. A stage's table goes once the next one is
    written.

    Null and empty texts, null and repeated doc_ids, equal rows and columns of any further names are defined by the
    stages, each for itself; an empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
