"""Graphs in the tagged binary format (.gr): a header and records of vertex data or arcs, little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascadia.functions.tables import settle
from cascadia.operators.graph import Graph

# fixed values: the header's first word and layout (magic, directed, padding, vertices, arcs, and the sizes of the
# graph's, a vertex's and an arc's further data), and the records' tags, a byte each
MAGIC, HEADER, VERTEX, ARC = 0x12341234, "<IB3xQQQQQ", 0, 2
#: Arcs that a task hands on together.
BATCH = 1 << 16


def head(data: bytes) -> tuple[int, bool, int, int, int, int]:
    """(vertices, directed, arcs, and the sizes of the graph's, a vertex's and an arc's further data)."""
    if len(data) < struct.calcsize(HEADER) or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not a binary graph")
    _, directed, n, m, whole, vertex, arc = struct.unpack_from(HEADER, data)
    return n, bool(directed), m, whole, vertex, arc


def records(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, rows of bytes without it) of each run of records with one tag, in order. Other tags raise."""
    vertex, arc = head(data)[4:]
    sizes = {VERTEX: 1 + vertex, ARC: 9 + arc}
    raw, at = np.frombuffer(data, np.uint8), struct.calcsize(HEADER)
    while at < len(raw):
        tag = int(raw[at])
        size = sizes.get(tag)
        if size is None or at + size > len(raw):
            raise ValueError("corrupt binary graph")
        many, step = 1, 1
        while True:  # runs are looked at in growing stretches
            own = raw[at : at + min(many + step, (len(raw) - at) // size) * size].reshape(-1, size)
            other = np.flatnonzero(own[many:, 0] != tag)
            more = int(other[0]) if len(other) else len(own) - many
            many += more
            if len(other) or not more:
                break
            step *= 2
        yield tag, raw[at : at + many * size].reshape(many, size)[:, 1:]
        at += many * size


def decode(data: bytes) -> tuple[int, bool, np.ndarray, np.ndarray]:
    """(vertices, directed, tails, heads). Further data of vertices and arcs are skipped."""
    ends = [x[:, :8].copy().view("<u4") for tag, x in records(data) if tag == ARC] or [np.empty((0, 2), "<u4")]
    both = np.concatenate(ends).astype(np.int64)
    return *head(data)[:2], both[:, 0], both[:, 1]


def encode(n: int, directed: bool, tails: np.ndarray, heads: np.ndarray) -> bytes:
    """The format's bytes for arcs without further data."""
    return struct.pack(HEADER, MAGIC, directed, n, len(tails), 0, 0, 0) + _arcs(tails, heads).tobytes()


def _arcs(tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
    out = np.full((len(tails), 9), ARC, np.uint8)
    out[:, 1:] = np.stack([tails, heads], axis=1).astype("<u4").view(np.uint8)
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path if path.endswith(".gr") else f"{path}.gr").where("length > 0")


def read(spark: SparkSession, path: str, **options) -> Graph:
    """A .gr file (the ending may be left out), or a folder of parts, each of them such a file of its own with less than
    2 GB. options go to Graph.from_arcs."""
    files = _files(spark, path)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content").to_pylist():
                for tag, rows in records(x):
                    for i in range(0, len(rows) if tag == ARC else 0, BATCH):
                        ends = rows[i : i + BATCH, :8].copy().view("<u4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content").to_pylist():
                n, directed = head(x)[:2]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([directed])], names=["n", "directed"])

    top = files.select("content").mapInArrow(heads, "n long, directed boolean").orderBy("n", ascending=False).first()
    if top is None:
        raise ValueError(f"{path} is empty")
    options.setdefault("directed", top["directed"])
    return Graph.from_arcs(files.select("content").mapInArrow(arcs, "src long, dst long"), n=top["n"], **options).validated()


def vertex_data(spark: SparkSession, path: str) -> DataFrame:
    """v, data: the further data of a file's vertices, in whose order they are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content").to_pylist():
                at = 0
                for tag, rows in records(x):
                    if tag == VERTEX:
                        for i in range(0, len(rows), BATCH):
                            own = rows[i : i + BATCH]
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(own))), pa.array([r.tobytes() for r in own], pa.binary())], names=["v", "data"])
                            at += len(own)

    return _files(spark, path).select("content").mapInArrow(run, "v long, data binary")


def arc_data(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, data: the arcs of a file or folder with their further data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content").to_pylist():
                for tag, rows in records(x):
                    for i in range(0, len(rows) if tag == ARC else 0, BATCH):
                        own = rows[i : i + BATCH]
                        ends = own[:, :8].copy().view("<u4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array([r.tobytes() for r in own[:, 8:]], pa.binary())], names=["src", "dst", "data"])

    return _files(spark, path).select("content").mapInArrow(run, "src long, dst long, data binary")


def write(graph: Graph, path: str, parts: int | None = None) -> None:
    """The graph as a folder (its name ends with .gr) of parts, each a whole file with its own arcs, in order of tails.

    Rows are written as text lines: the line feed after each is the arc's one byte of further data, which readers skip
    (a graph without arcs has one vertex record in place of them). An undirected graph's edges are written once."""
    spark, n, directed = graph.arcs.sparkSession, graph.n, graph.directed
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    arcs = graph.arcs if directed else graph.arcs.where("src <= dst")
    arcs = settle(arcs.select(F.least(F.lit(parts - 1), F.floor(F.col("src") * parts / max(1, n))).cast("int").alias("part"), "src", "dst"), "parts")
    counts = {r["part"]: r["count"] for r in arcs.groupBy("part").count().collect()}  # a number for each part

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = True
        for b in batches:
            if b.num_rows:
                rows = [x.tobytes() for x in _arcs(b.column("src").to_numpy(), b.column("dst").to_numpy())]
                if fresh:
                    rows[0] = struct.pack(HEADER, MAGIC, directed, n, counts[b.column("part")[0].as_py()], 0, 1, 1) + rows[0]
                fresh = False
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    if counts:
        rows = arcs.repartitionById(parts, "part").sortWithinPartitions("part", "src", "dst").mapInArrow(lines, "value binary")
    else:
        rows = spark.createDataFrame([(struct.pack(HEADER, MAGIC, directed, n, 0, 0, 1, 1) + bytes([VERTEX]),)], "value binary").coalesce(1)
    rows.select(F.col("value").cast("string")).write.text(path if path.endswith(".gr") else f"{path}.gr")
