"""The live-edge hash as Spark columns, DuckDB SQL text and plain Python.

A 32-bit Murmur3-style hash of three words (tail, head, instance) under the start value (seed << 16) + instances. All
arithmetic is in BIGINT, where the product of two unsigned 32-bit numbers would overflow: Spark columns take them as
signed ones, SQL text splits a factor in halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the hash's constants
C1, C2, ADD, LAST, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 10, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF
#: Hash values are compared with thresholds modulo this.
RESOLUTION = 3_000_000


def start(seed: int, l: int) -> int:  # noqa: E741
    return ((seed << 16) + l) & MASK


def murmur(u: int, v: int, i: int, l: int, seed: int) -> int:  # noqa: E741
    """The hash in plain Python; ids up to 2 ** 32 - 1."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & MASK
    h = start(seed, l)
    for n, word in enumerate((u, v, i)):
        h ^= rot(word * C1 & MASK, 15) * C2 & MASK
        if n < 2:
            h = (rot(h, 13) * 5 + ADD) & MASK
    h ^= LAST
    h = (h ^ h >> 16) * MIX1 & MASK
    h = (h ^ h >> 13) * MIX2 & MASK
    return h ^ h >> 16


def _mul(a: Column, c: int) -> Column:
    """As factors of a signed product, which 63 bits hold; a stands once, so that plans with filters stay small."""
    return (F.shiftright(F.shiftleft(a, 32), 32) * (c - (1 << 32) if c >> 31 else c)).bitwiseAND(MASK)


def _rot(a: Column, r: int) -> Column:
    return (a * (1 << r)).bitwiseAND(MASK) + F.shiftright(a, 32 - r)


def _stages(df: DataFrame, name: str, steps: list) -> DataFrame:
    """One projection a step, so that no step's text is repeated in the next."""
    for step in steps:
        df = df.withColumn(name, step)
    return df


def _word(df: DataFrame, word: Column, go_on: bool) -> DataFrame:
    df = _stages(df, "_k", [_mul(word.cast("long"), C1), _rot(F.col("_k"), 15), _mul(F.col("_k"), C2)])
    steps = [F.col("_h").bitwiseXOR(F.col("_k"))]
    if go_on:
        steps += [_rot(F.col("_h"), 13), (F.col("_h") * 5 + ADD).bitwiseAND(MASK)]
    return _stages(df, "_h", steps)


def pair_state(df: DataFrame, u: str, v: str, l: int, seed: int, out: str) -> DataFrame:  # noqa: E741
    """The hash's state after two words: it is the same for all instances of an arc."""
    df = df.withColumn("_h", F.lit(start(seed, l)).cast("long"))
    df = _word(_word(df, F.col(u), True), F.col(v), True)
    return df.withColumnRenamed("_h", out).drop("_k")


def finish(df: DataFrame, state: str, i: str, out: str) -> DataFrame:
    """The hash from the state and the third word."""
    df = _word(df.withColumnRenamed(state, "_h"), F.col(i), False)
    df = _stages(df, "_h", [F.col("_h").bitwiseXOR(LAST)])
    for shift, c in ((16, MIX1), (13, MIX2)):
        df = _stages(df, "_h", [F.col("_h").bitwiseXOR(F.shiftright("_h", shift)), _mul(F.col("_h"), c)])
    return _stages(df, "_h", [F.col("_h").bitwiseXOR(F.shiftright("_h", 16))]).withColumnRenamed("_h", out).drop("_k")


def hashed(df: DataFrame, u: str, v: str, i: str, l: int, seed: int, out: str = "h") -> DataFrame:  # noqa: E741
    """df with the hash of the three columns."""
    return finish(pair_state(df, u, v, l, seed, "_state"), "_state", i, out)


def hash_sql(source: str, u: str, v: str, i: str, l: int, seed: int, out: str = "h") -> str:  # noqa: E741
    """DuckDB SQL for source (a table name or parenthesised query) with the hash as a further column."""
    mul = lambda a, c: f"((({a} & 65535) * {c} + (((({a} >> 16) * {c}) & 65535) * 65536)) & {MASK})"
    rot = lambda a, r: f"((({a} * {1 << r}) & {MASK}) + ({a} >> {32 - r}))"
    steps, h = [], str(start(seed, l))
    for n, word in enumerate((u, v, i)):
        steps.append(mul(f"({word})::BIGINT", C1))
        steps.append(rot(f"z{len(steps) - 1}", 15))
        steps.append(mul(f"z{len(steps) - 1}", C2))
        steps.append(f"xor({h}::BIGINT, z{len(steps) - 1})")
        if n < 2:
            steps.append(rot(f"z{len(steps) - 1}", 13))
            steps.append(f"((z{len(steps) - 1} * 5 + {ADD}) & {MASK})")
        h = f"z{len(steps) - 1}"
    steps.append(f"xor({h}, {LAST})")
    for shift, c in ((16, MIX1), (13, MIX2)):
        steps.append(f"xor(z{len(steps) - 1}, z{len(steps) - 1} >> {shift})")
        steps.append(mul(f"z{len(steps) - 1}", c))
    steps.append(f"xor(z{len(steps) - 1}, z{len(steps) - 1} >> 16)")
    sql = source
    for n, step in enumerate(steps):
        sql = f"(SELECT *, {step} AS z{n} FROM {sql})"
    drop = ", ".join(f"z{n}" for n in range(len(steps)))
    return f"(SELECT * EXCLUDE ({drop}), z{len(steps) - 1} AS {out} FROM {sql})"
