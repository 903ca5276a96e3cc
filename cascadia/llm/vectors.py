"""Vectors of a table as bytes, checked, with a key that equal vectors share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors that load() wrote, in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def load(df: DataFrame, *names: str) -> DataFrame:
    """names, vec (the components as doubles), key (16 bytes) and norm. Vectors that are null, empty or zero, or hold
    null or non-finite components, or whose square overflows, have null vec, key and norm."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(sizes)
            vec, key, norm = [], [], []
            with np.errstate(over="ignore", invalid="ignore"):
                for e, n in zip(ends, sizes, strict=True):
                    x = flat[e - n : e]
                    length = float(np.sqrt(x @ x)) if n else 0.0
                    good = 0 < length < np.inf
                    data = x.tobytes() if good else None
                    vec.append(data)
                    key.append(hashlib.blake2b(data, digest_size=16).digest() if good else None)
                    norm.append(length if good else None)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(vec, pa.binary()), pa.array(key, pa.binary()), pa.array(norm, pa.float64())], names=[*names, "vec", "key", "norm"])

    return df.select(*names, "embedding").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", vec binary, key binary, norm double")


def drawn(df: DataFrame, n: int, total: int) -> pa.Table:
    """n of about total rows, those with the smallest hashes of their keys: a bounded sample, the same in every run.
    A bound on the hash, four times as loose as needed, keeps all but some rows from being sorted."""
    h = F.xxhash64("key")
    if total > 8 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * n / total)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), "key").limit(n).toArrow()
