"""Results of one round of an iteration, written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset in local mode (tests) a folder of our own. Elsewhere
    executors would not share that one, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir, a folder that driver and executors share, must be set on {master}")
        found = "file://" + tempfile.mkdtemp(prefix="cascadia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
