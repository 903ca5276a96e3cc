"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cascadia.functions.tables import shared_dir

#: The operation by which HotSpot on Linux hands freed native memory back.
TRIM = "systemTrimNativeHeap"

_written: list[str] = []
_left: list[str] = []


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and a lost executor costs
    no more than the tasks it had."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a table that table() has written and that nothing lazy reads any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """For the end of a round of many jobs, whose results are written: frees what their plans hold on the driver. Spark
    removes broadcasts and shuffle files of frames that are gone after a collection alone. What the JVM's compilers
    have freed goes back to the system too, where the JVM can do that: malloc would keep some 200 MB."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() in ("isRegistered", "getMBeanInfo", "invoke")}

    def call(name, *args):  # the server's own class is hidden, its interface is not
        given = gateway.new_array(jvm.java.lang.Object, len(args))
        for i, x in enumerate(args):
            given[i] = x
        return methods[name].invoke(beans, given)

    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    if call("isRegistered", commands) and TRIM in {x.getName() for x in call("getMBeanInfo", commands).getOperations()}:
        call("invoke", commands, TRIM, None, None)


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """For a stage whose predecessor's result is already written out: deletes the tables that stages left before, and
    lets go of their plans, broadcasts and shuffle files, which Spark cleans up after a collection alone."""
    while _left:
        delete(spark, _left.pop())
    let_go(spark)
    at = len(_written)
    try:
        yield
    finally:
        _left.extend(_written[at:])
        del _written[at:]


def shards(spark: SparkSession, rows: int = 0, fill: int = 1) -> int:
    """Into how many groups packed payloads are dealt: the session's number of shuffle partitions, or four times as
    many and more where each would else have over fill of the rows."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(4 * parts, -(-(rows or 0) // fill)) if fill > 1 else parts
