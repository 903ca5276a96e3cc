"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), in order. Inverted lists are kept for every pair of
pivots, so that being on one list is sharing two pivots or more; the vectors of a list are compared exactly. Equal
vectors of a label are one class, which stands on the lists once, with its number of rows and a node number of its
own: vec_ids may be null or repeated. A list longer than BLOCK is dealt into blocks and every two blocks are compared
in a group of their own, in tiles; a group returns sums and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.llm.components import components
from cascadia.llm.store import shards, table
from cascadia.llm.vectors import drawn, load, matrix

#: Nearest pivots that describe a vector; two of them shared make a candidate.
NEAREST = 5
#: Vectors of a list's block, vectors compared at a time, and list entries that a task gathers, about.
BLOCK, TILE, FILL = 4096, 512, 16_384


def pivots(rows: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) unit vectors (32 to 1024) from a bounded sample; none within cosine 0.9 of another."""
    want = min(1024, max(32, int(2 * sqrt(n))))
    found = matrix(drawn(rows.select("key", "vec"), 4 * want, n).column("vec"))
    if not len(found):
        return found
    found = found / np.linalg.norm(found, axis=1, keepdims=True)
    out = found[:1]
    for x in found[1:]:
        if len(out) < want and (out @ x).max() < 0.9:
            out = np.vstack([out, x])
    return out


def _lists(points: np.ndarray):
    m = min(NEAREST, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"))
            sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ points.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :m]
            ids = np.sort(near, axis=1).astype(np.int64)
            pairs = list(combinations(range(m), 2)) or [(0, 0)]
            cells = np.stack([ids[:, i] * len(points) + ids[:, j] for i, j in pairs], axis=1).ravel()
            row = np.repeat(np.arange(b.num_rows), len(pairs))
            at = pa.array(row)
            own = pa.array([r.tobytes() for r in ids], pa.binary()).take(at)
            yield pa.RecordBatch.from_arrays([b.column("label").take(at), pa.array(cells), b.column("node").take(at), b.column("copies").take(at), b.column("vec").take(at), own], names=["label", "cell", "node", "copies", "vec", "near"])

    return run


def _tiles(first: np.ndarray, second: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    for a in range(0, len(first), TILE):
        for b in range(a if same else 0, len(second), TILE):
            yield first[a : a + TILE], second[b : b + TILE], same and a == b


def _compare(points: int, cosine: float):
    """Of each two blocks of a list: for every node its links found there (times the copies), and a link to the
    smallest node that it reaches; further links (with 0 to count) join what tiles found apart."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("cell", "ascending"), ("bi", "ascending"), ("bj", "ascending")])
        head = list(zip(*(t.column(c).to_pylist() for c in ("label", "cell", "bi", "bj")), strict=True))
        node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
        vecs, near = matrix(t.column("vec")), np.frombuffer(b"".join(t.column("near").to_pylist()), np.int64).reshape(t.num_rows, -1)
        vecs = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        low, count = node.copy(), np.zeros(len(node), np.int64)
        joins = [np.empty((2, 0), np.int64)]
        far = np.iinfo(np.int64).max
        at = 0
        for (_, cell, bi, bj), same in groupby(head):
            n = sum(1 for _ in same)
            own = np.arange(at, at + n)
            at += n
            first = own[block[own] == bi]
            second = first if bi == bj else own[block[own] == bj]
            a, b = divmod(cell, points)
            for x, y, diagonal in _tiles(first, second, bi == bj):
                hit = vecs[x] @ vecs[y].T >= cosine
                if diagonal:
                    np.fill_diagonal(hit, False)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                # a pair counts on the first list that it shares: no shared pivot but the list's own comes before its second
                p, q = near[x[i]], near[y[j]]
                shared = (p[:, :, None] == q[:, None, :]).any(axis=2)
                once = ((p < b) & shared).sum(axis=1) == (1 if a != b else 0)
                count[x] += np.bincount(i[once], copies[y[j[once]]], len(x)).astype(np.int64)
                if not diagonal:
                    count[y] += np.bincount(j[once], copies[x[i[once]]], len(y)).astype(np.int64)
                before = np.concatenate([low[x], low[y]])
                while True:
                    p, q = low[x], low[y]
                    low[x] = np.minimum(p, np.where(hit, q, far).min(axis=1))
                    low[y] = np.minimum(low[y], np.where(hit, low[x][:, None], far).min(axis=0))
                    if (low[x] == p).all() and (low[y] == q).all():
                        break
                after = np.concatenate([low[x], low[y]])
                moved = before != after
                if moved.any():
                    joins.append(np.unique(np.stack([before[moved], after[moved]]), axis=1))
        keep = (count > 0) | (low != node)
        joins = np.unique(np.concatenate(joins, axis=1), axis=1)
        cat = lambda x, y: pa.array(np.concatenate([x[keep], y]), pa.int64())
        return pa.table({"u": cat(node, joins[0]), "links": cat(count, np.zeros(joins.shape[1], np.int64)), "v": cat(low, joins[1])})

    return run


def near(df: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row of df: vec_id, n_links (other rows of the same label with at least this cosine), component_id (the
    smallest vec_id of the rows reachable by links, itself included) and kept (vec_id is that).

    Vectors that are null, zero, or hold null or non-finite components, and those of a null label or another number of
    components than most, link with nothing and are kept. Rows with one vec_id are vectors of their own, within a
    label or in several: they link by their vectors alone, and all of them are kept if that vec_id is their
    component's smallest. A row with a null vec_id links as others do; its component_id is the smallest vec_id of the
    others, or null (and it is kept) if they have none. Retrieval may miss a pair whose nearest pivots differ; links
    found are exact. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = table(load(df, "vec_id", "label"), "near-rows")
    good = rows.where("key is not null and label is not null")
    dims = good.groupBy(F.length("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    reps = good.where(F.length("vec") == (dims["d"] if dims else 0)).groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = table(reps.withColumn("node", F.monotonically_increasing_id()), "near-reps")
    points = pivots(reps, reps.count())
    if len(points):
        posts = table(reps.mapInArrow(_lists(points), f"label {dict(df.dtypes)['label']}, cell long, node long, copies long, vec binary, near binary"), "near-lists")
        sizes = table(posts.groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1").select("label", "cell", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-sizes")
        groups = shards(spark, sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0], FILL)
        dealt = posts.join(sizes.drop("n"), ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("label", "cell", "bi", "bj"), F.lit(groups)))
        found = table(dealt.select("shard", "label", "cell", "bi", "bj", "block", "node", "copies", "vec", "near").groupBy("shard").applyInArrow(_compare(len(points), cosine), "u long, links long, v long"), "near-links")
    else:
        found = spark.createDataFrame([], "u long, links long, v long")
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v"))
    per = reps.select("label", "key", "rep", "copies", "node").join(counts.withColumnRenamed("u", "node"), "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = per.groupBy("root").agg(F.min("rep").alias("component_id"))
    per = per.join(least, "root").select(F.col("label").alias("l"), F.col("key").alias("k"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("in_class"))
    out = rows.select("vec_id", "label", "key").join(per, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    component = F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_near_vectors(spark, sf_dir):
    """Links and components of all embeddings with cosine 0.98 or more within a label."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in SQL, for unique vec_ids: every two vectors of a label.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y),
named AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM linked l WHERE l.x = e.vec_id)::BIGINT AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON n.x = e.vec_id
"""
