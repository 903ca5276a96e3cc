"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are put in bands by norm and lifted to the unit sphere of their band, where nearness by inner product is
nearness by distance. A table's bucket is the tuple of cells, each WIDTH wide, into which Gaussian projections fall. A
query's buckets in a table are visited in the order of the estimated probability that a neighbour at the distance
sought falls into them, until these sum up to the share wanted: a neighbour's projection is normal about the query's
own, scaled by their cosine. Candidates of all tables are merged and ranked by the exact product.

The likeliest buckets of each table go first, a block of each; the k-th best score found there bounds the true one from
below, and what the other blocks and buckets then hand on are only candidates that reach it. With the square root of
all blocks asked in the first round, both rounds hand on about as much. No block is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.llm.store import shards, table
from cascadia.llm.vectors import drawn, load, matrix

TABLES, WIDTH = 3, 1.5
#: Probability, over the tables, of meeting a neighbour at the distance sought.
SOUGHT = 0.97
#: Rows of the sample from which that distance and a floor of the scores are taken.
SAMPLE = 4096
#: Rows of a bucket and probes of it that meet in one group, rows a bucket should have, and both that a task gathers.
BLOCK, PROBES, FILL, GATHER = 1024, 4096, 2048, 32_768
#: Rounding of a product of two vectors, as a share of their lengths' product.
SLACK = 1e-9

_erf = np.vectorize(erf, otypes=[float])


def functions(dims: int, per: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Projections (tables, per, dims + 1) and offsets (tables, per)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((TABLES, per, dims + 1)), rng.uniform(0, WIDTH, (TABLES, per))


def cells(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, tables): each row's bucket, its cells as digits."""
    z = np.floor((np.einsum("nd,tkd->ntk", x, a) + b) / WIDTH).astype(np.int64)
    return _number(np.clip(z, -15, 16))


def _number(z: np.ndarray) -> np.ndarray:
    out = np.zeros(z.shape[:-1], np.int64)
    for k in range(z.shape[-1]):
        out = out * 32 + z[..., k] + 15
    return out


def _blocks(n, size: int):
    return F.ceil(n / size).cast("int")


def probes(f: np.ndarray, b: np.ndarray, cosine: float, share: float) -> np.ndarray:
    """Buckets of one table for a query with projections f, likeliest first, until their probabilities sum to share."""
    spread = sqrt(max(1e-6, 1 - cosine * cosine))
    lines = np.arange(-15, 17)
    chance, number = np.ones(1), np.zeros(1, np.int64)
    for mean, shift in zip(f * cosine, b, strict=True):
        edge = (np.append(lines, 17) * WIDTH - shift - mean) / spread / sqrt(2)
        edge[0], edge[-1] = -40, 40
        p = np.diff(_erf(edge)) / 2
        keep = p > 1e-5
        chance = np.outer(chance, p[keep]).ravel()
        number = (number[:, None] * 32 + lines[keep] + 15).ravel()
        order = np.argsort(-chance, kind="stable")
        upto = int(np.searchsorted(np.cumsum(chance[order]), min(1.0, share + (1 - share) * 0.9))) + 1
        chance, number = chance[order][:upto], number[order][:upto]
    upto = int(np.searchsorted(np.cumsum(chance), share)) + 1
    return number[:upto]


def _lift(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    y = x / top[:, None]
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]])


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Indices of each q's k rows with the largest s, ties to the smaller v; a (q, v) counts once."""
    order = np.lexsort((v, -s, q))
    q, v = q[order], v[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # the same pair has the same score
    order, q = order[fresh], q[fresh]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def search(df: DataFrame, queries, k: int = 20, sought: float = SOUGHT) -> DataFrame:
    """Per query (a row of df for which the Column queries holds) its k nearest other rows found: query_id, rank (from
    1), vec_id and score, the inner product in double precision.

    Vectors that are null, zero, or hold null or non-finite components, and those with another number of components
    than most, take no part, neither as queries nor as candidates; nor do null vec_ids. Rows with one vec_id count once
    as candidates and once as queries, with the vector whose key is smallest. With k candidates or fewer all of them are found. Of equal vectors the k + 1 smallest vec_ids
    stand for all, which loses no answer. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = load(df, "vec_id").where("key is not null and vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("key", "vec", "norm")).alias("one")).select("vec_id", "one.vec", "one.key", "one.norm")
    rows = table(rows, "ann-rows")
    dims = rows.groupBy(F.length("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = dims["d"] if dims else 8
    rows = rows.where(F.length("vec") == d)
    same = Window.partitionBy("key").orderBy("vec_id")
    index = table(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r").withColumn("band", F.round(F.log2("norm")).cast("int")), "ann-index")
    asked = rows.where(queries)
    bands = {r["band"]: (r["top"], r["n"]) for r in index.groupBy("band").agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect()}  # at most one for each exponent of a double
    n = sum(c for _, c in bands.values())
    per = max(1, round(log(max(1.0, n / FILL)) / log(2.5)))
    a, b = functions(d // 8, per)
    some = drawn(index, SAMPLE, n)
    base, base_id = matrix(some.column("vec")), some.column("vec_id").to_numpy()
    order = max(1, ceil(k * len(base_id) / max(1, n)))
    share = 1 - (1 - sought) ** (1 / TABLES)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                top = np.array([bands[x][0] for x in t.column("band").to_pylist()])
                c = cells(_lift(matrix(t.column("vec")), top), a, b)
                at = pa.array(np.repeat(np.arange(t.num_rows), TABLES))
                yield pa.RecordBatch.from_arrays([t.column("band").take(at), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), t.num_rows)), pa.array(c.ravel()), t.column("vec_id").take(at), t.column("vec").take(at)], names=["band", "tab", "cell", "vec_id", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            ids, x = t.column("vec_id").to_numpy(), matrix(t.column("vec"))
            norm = np.linalg.norm(x, axis=1)
            s = x @ base.T
            s[ids[:, None] == base_id[None, :]] = -np.inf
            s = -np.sort(-s, axis=1)
            # the sample's k-th score bounds the true one from below; the one of the k-th's rank in the sample is near it
            floor = s[:, k - 1] if s.shape[1] >= k else np.full(len(ids), -np.inf)
            aim = s[:, min(order, s.shape[1]) - 1]
            row, band, tab, cell, turn, most = [], [], [], [], [], []
            unit = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
            f = np.einsum("nd,tkd->ntk", unit, a)
            for i in range(len(ids)):
                for e, (top, count) in bands.items():
                    if n > k + 1 and floor[i] > top * norm[i] * (1 + SLACK):
                        continue  # nothing in this band reaches the floor
                    cosine = min(0.999, max(0.0, aim[i] / (top * norm[i]))) if np.isfinite(aim[i]) else 0.0
                    for j in range(TABLES):
                        got = probes(f[i, j], b[j], cosine, share if n > 4 * k else 1.0)
                        row.append(np.full(len(got), i))
                        band.append(np.full(len(got), e, np.int32))
                        tab.append(np.full(len(got), j, np.int32))
                        cell.append(got)
                        turn.append(np.arange(len(got), dtype=np.int32))
                        most.append(np.full(len(got), top * norm[i]))
            row = np.concatenate(row) if row else np.empty(0, np.int64)
            cat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([cat(band, pa.int32()), cat(tab, pa.int32()), cat(cell, pa.int64()), cat(turn, pa.int32()), cat(most, pa.float64()), t.column("vec_id").take(at), t.column("vec").take(at), pa.array(floor[row])], names=["band", "tab", "cell", "turn", "most", "query_id", "vec", "floor"])

    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posts = table(index.select("band", "vec_id", "vec").mapInArrow(put, "band int, tab int, cell long, vec_id long, vec binary"), "ann-posts")
    probing = table(asked.select("vec_id", "vec").mapInArrow(ask, "band int, tab int, cell long, turn int, most double, query_id long, vec binary, floor double"), "ann-probes")
    cell_of = ["band", "tab", "cell"]
    # a bucket that many ask for is copied for each block of its probes
    asks = probing.groupBy(*cell_of).agg(_blocks(F.count("*"), PROBES).alias("ask_blocks"))
    sizes = table(posts.groupBy(*cell_of).agg(_blocks(F.count("*"), BLOCK).alias("blocks")).join(asks, cell_of), "ann-sizes")
    probing = probing.join(sizes, cell_of).withColumn("ask_block", F.pmod(F.xxhash64("query_id"), F.col("ask_blocks")).cast("int"))
    stored = posts.join(sizes, cell_of).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    stored = stored.withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    own = F.pmod(F.xxhash64(F.lit(1), "query_id"), F.col("blocks")).cast("int")  # the block that a query looks at first
    least = (F.col("floor") - F.col("most") * SLACK).alias("floor")
    place = [*cell_of, "block", "ask_block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        where = {}
        for side, t in enumerate((left, right)):
            for i, key in enumerate(zip(*(t.column(c).to_pylist() for c in place), strict=True)):
                where.setdefault(key, ([], []))[side].append(i)
        x, y = matrix(left.column("vec")), matrix(right.column("vec"))
        ids, asks, floor = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy(), right.column("floor").to_numpy()
        q, v, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for stored_at, probes_at in where.values():
            if not stored_at or not probes_at:
                continue
            stored_at = np.array(stored_at)
            for at in range(0, len(probes_at), 2048):
                some = np.array(probes_at[at : at + 2048])
                score = y[some] @ x[stored_at].T
                score[(asks[some][:, None] == ids[stored_at][None, :]) | (score < floor[some][:, None])] = -np.inf
                i, j = np.nonzero(score > -np.inf)
                exact = np.concatenate([np.einsum("nd,nd->n", y[some[i[c : c + 65536]]], x[stored_at[j[c : c + 65536]]]) for c in range(0, len(i), 65536)]) if len(i) else np.empty(0)
                best = _best(asks[some][i], ids[stored_at[j]], exact, k)
                q.append(asks[some][i[best]])
                v.append(ids[stored_at[j[best]]])
                s.append(exact[best])
        q, v, s = map(np.concatenate, (q, v, s))
        best = _best(q, v, s, k)
        return pa.table({"query_id": q[best], "vec_id": v[best], "score": s[best]})

    def best(asking: DataFrame, groups: int) -> DataFrame:
        """query_id, vec_id, score: for each query (query_id, vec, floor, and the place that it asks) what it finds."""
        unit = F.pmod(F.xxhash64(*place), F.lit(groups)).alias("shard")
        left, right = stored.select(unit, *place, "vec_id", "vec"), asking.select(unit, *place, "query_id", "vec", "floor")
        return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(meet, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return found.where(F.col("rank") <= k)

    r = probing.agg(F.countDistinct("query_id"), F.sum("blocks")).first()
    turns = max(1, round(sqrt((r[1] or 0) / max(1, r[0])) / TABLES))
    at_first = probing.where(F.col("turn") < turns).select(*cell_of, "ask_block", "query_id", "vec", least, own.alias("block"))
    first = table(ranked(best(at_first, shards(spark, posts.count() + turns * TABLES * r[0], GATHER))), "ann-first")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    later = probing.join(floors, "query_id", "left").withColumn("floor", F.greatest("floor", "reached")).where(F.col("floor") <= F.col("most") * (1 + SLACK))
    later = later.select(*cell_of, "turn", "ask_block", "query_id", "vec", least, own.alias("own"), every).where((F.col("turn") >= turns) | (F.col("block") != F.col("own")))
    rest = best(later, shards(spark, posts.count() + (r[1] or 0), GATHER))
    return ranked(first.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark, sf_dir):
    """The 20 nearest of all embeddings for every one whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
