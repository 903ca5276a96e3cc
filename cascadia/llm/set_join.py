"""Exact n-gram Jaccard join of whole texts with set-relation skipping.

Every document becomes a set of shingle hashes; equal sets are one class. Shingles are ordered by how often the whole
corpus has them (a sketch of bounded size; any order is exact, a good one is fast), and the first ones of each set, its
prefix, stand on index lists with size and position: linked sets share a list, and size and position bound the overlap
that a pair on a list can still have, so whole blocks of a list are skipped.

Answers are derived from those of similar sets. First each set is checked against one set only, the one with which it
shares most lists among those that lead a list. Sets linked to a common leader are connected, whatever else they
share, so that afterwards only pairs on a list that are not connected yet are looked at: first those of each set and
the nearest ones that it meets, then all that are still not connected. Groups of near copies therefore cost some
checks per member, not one per pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.llm.components import components
from cascadia.llm.store import drop, let_go, shards, table
from cascadia.llm.words import CHUNK, cut, mix, shingles, slices

#: Counters of the corpus sketch, and into how many pieces it is cut on its way.
SKETCH, PIECES = 1 << 20, 16
#: Bits of a set's short parity map, which bounds the overlap of two sets from above; its long one has half as many
#: bits as the set has elements, up to so many.
BITS, LONG_BITS = 512, 1 << 24
#: Bits of a filter on doc_ids, at most; eight for each doc_id. Beyond that texts are found by a join.
MARKS = 1 << 26
#: Bytes of packed list entries that a task gathers before it hands them on.
BUFFER = 16 << 20
#: Entries of a list that are skipped together.
LIST_BLOCK = 64
#: Of a set's lists so many, the first ones, tell whether a pair was met before.
HEAD = 8


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's shingle hashes, distinct, ascending."""
    w = cut(texts, lower=True)
    h, first = shingles(w, w.hashes()[0], k)
    for a, b in zip(first, first[1:], strict=False):
        yield np.unique(h[a:b])


def digest(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    total = mix(s, 11).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64), 12).view(np.int64)[0])


def parity(s: np.ndarray) -> np.ndarray:
    """The long parity map: bit i is odd if the set has an odd number of elements that fall there. Maps of two lengths
    compare once the longer one is folded."""
    m = max(BITS, 1 << max(0, (len(s) // 2 - 1).bit_length()))
    m = min(m, LONG_BITS)
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % m, minlength=m) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A parity map of so many bytes from a longer one."""
    return x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def _scan(k: int):
    """Rows of kind 0: doc_id, n, key (the digest), bits (the short parity map) and long (the long one, null if it
    is no longer); of kind 1: pieces of the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(SKETCH, np.int64), None
        for b in slices(batches, size=CHUNK):
            kind, n, key, bits, long = b.column("doc_id").type, [], [], [], []
            for s in sets(b.column("text"), k):
                n.append(len(s))
                key.append(digest(s))
                odd = parity(s)
                bits.append(folded(odd, BITS // 8).tobytes())
                long.append(odd.tobytes() if len(odd) > BITS // 8 else None)
                if len(s) > SKETCH >> 6:
                    sketch += np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                else:
                    sketch[(s % np.uint64(SKETCH)).astype(np.int64)] += 1  # two of a set in one counter count once: it is a sketch
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column("doc_id"), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(bits, pa.binary()), pa.array(long, pa.binary()), pa.nulls(b.num_rows, pa.int32()), none], names=["kind", "doc_id", "n", "key", "bits", "long", "piece", "counts"])
        if kind is not None:
            size, task = SKETCH // PIECES, TaskContext.get().partitionId()
            data = [zlib.compress(np.minimum(sketch[i * size : (i + 1) * size], 0xFFFFFFFF).astype("<u4").tobytes(), 1) for i in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(PIECES, np.int32)), pa.nulls(PIECES, kind), pa.array(np.full(PIECES, task, np.int32)), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, pa.binary()), pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(data, pa.binary())], names=["kind", "doc_id", "n", "key", "bits", "long", "piece", "counts"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // PIECES, np.int64)
    for x in t.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(x), "<u4")
    return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)], pa.binary())})


def _prefixes(k: int, percent: int, parts: int, sketch):
    """Packed list entries (shingle, set, size, position) by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done, held, size = sketch.value, set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                tok, key, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                shard = (mix(tok, 21) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(parts + 1))
                data, at = [], []
                for i in range(parts):
                    own = order[edges[i] : edges[i + 1]]
                    if len(own):
                        at.append(i)
                        data.append(b"".join((np.int64(len(own)).tobytes(), tok[own].tobytes(), key[own].tobytes(), n[own].tobytes(), pos[own].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])
                held.clear()

        for b in slices(batches, size=CHUNK):
            for s in sets(b.column("text"), k):
                if not len(s) or (key := digest(s)) in done:
                    continue
                done.add(key)
                common = counts[(s % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
                many = len(s) - -(-percent * len(s) // 100) + 1
                rank = np.argsort((common << np.uint64(32)) | (s >> np.uint64(32)), kind="stable")[:many]
                held.append((s[rank], np.full(many, key), np.full(many, len(s), np.int32), np.arange(many, dtype=np.int32)))
                size += 24 * many
            if size > BUFFER:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which sets of n and m elements are linked: 100 x >= percent (n + m - x)."""
    return -(-percent * (n.astype(np.int64) + m) // (100 + percent))


def _runs(tok: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.empty(0, np.int64)


def _lists(percent: int):
    """Of a shard's lists those with two sets or more. Rows of kind 0: their entries; of kind 1: for each entry the
    set that leads the list among those near enough in size, with the number of lists where that is so."""

    def run(t: pa.Table) -> pa.Table:
        parts = []
        for x in t.column("data").to_pylist():
            m = int(np.frombuffer(x, np.int64, 1)[0])
            parts.append((np.frombuffer(x, np.uint64, m, 8), np.frombuffer(x, np.int64, m, 8 + 8 * m), np.frombuffer(x, np.int32, m, 8 + 16 * m), np.frombuffer(x, np.int32, m, 8 + 20 * m)))
        tok, key, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, key, n, tok))
        tok, key, n, pos = tok[order], key[order], n[order], pos[order]
        fresh = np.r_[True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])]
        tok, key, n, pos = tok[fresh], key[fresh], n[fresh], pos[fresh]
        start = _runs(tok)
        count = np.diff(np.r_[start, len(tok)])
        many = np.repeat(count > 1, count)
        tok, key, n, pos = tok[many], key[many], n[many], pos[many]
        start = _runs(tok)
        run_of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(tok)]))
        # the first of the run with at least percent of the entry's size
        combined = run_of * (1 << 32) + n
        lead = np.searchsorted(combined, run_of * (1 << 32) + -(-percent * n.astype(np.int64) // 100))
        j = np.flatnonzero(lead < np.arange(len(tok)))
        i = lead[j]
        ok = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= _least(n[i], n[j], percent)
        pairs, times = np.unique(np.stack([key[i[ok]], key[j[ok]]]), axis=1, return_counts=True)
        zero = lambda m, kind: pa.array(np.zeros(m, kind))
        a, b = len(tok), pairs.shape[1]
        cat = lambda x, y, kind: pa.array(np.concatenate([x.astype(kind), y.astype(kind)]))
        return pa.table({"kind": cat(np.zeros(a), np.ones(b), np.int32), "tok": pa.concat_arrays([pa.array(tok.view(np.int64)), zero(b, np.int64)]), "x": cat(key, pairs[0], np.int64), "y": pa.concat_arrays([zero(a, np.int64), pa.array(pairs[1].astype(np.int64))]), "n": cat(n, times, np.int32), "pos": cat(pos, np.zeros(b), np.int32)})

    return run


def _meet(tok: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, percent: int, test) -> None:
    """Calls test(i, j) with pairs of entries of one list, sorted by tok, n and pos, that are not connected yet and
    that size and position do not rule out."""
    start = _runs(tok)
    end = np.r_[start[1:], len(tok)]

    def some(i: np.ndarray, j: np.ndarray) -> None:
        ok = (group[i] != group[j]) & (100 * n[i] >= percent * n[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= _least(n[i], n[j], percent))
        if ok.any():
            test(i[ok], j[ok])

    short = (end - start) <= LIST_BLOCK
    width = int((end - start)[short].max(initial=0))
    run_of = np.repeat(np.arange(len(start)), end - start)
    for step in range(1, width):  # short lists: all entries against the one so many places on
        i = np.arange(len(tok) - step)
        i = i[(run_of[i] == run_of[i + step]) & short[run_of[i]]]
        some(i, i + step)
    for s, e in zip(start[~short], end[~short], strict=True):
        blocks = [(b, min(e, b + LIST_BLOCK)) for b in range(s, e, LIST_BLOCK)]
        for x, (a, b) in enumerate(blocks):
            one = group[a] if (group[a:b] == group[a]).all() else None
            for c, d in blocks[x:]:
                if 100 * n[b - 1] < percent * n[c]:
                    break  # sizes ascend: this and all later blocks are too large
                if one is not None and (group[c:d] == one).all():
                    continue
                if min((n[a:b] - pos[a:b]).max(), (n[c:d] - pos[c:d]).max()) < _least(n[a : a + 1], n[c : c + 1], percent)[0]:
                    continue
                i, j = np.divmod(np.arange((b - a) * (d - c)), d - c)
                i, j = i + a, j + c
                some(i[i < j], j[i < j])


def _sorted(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.lexsort((t.column("pos").to_numpy(), t.column("n").to_numpy(), t.column("tok").to_numpy()))))


def _live(percent: int):
    """Of a shard's lists the entries that size and position leave a set to meet that is not connected yet."""

    def run(t: pa.Table) -> pa.Table:
        t = _sorted(t)
        keep = np.zeros(t.num_rows, bool)

        def test(i: np.ndarray, j: np.ndarray) -> None:
            keep[i] = keep[j] = True

        _meet(t.column("tok").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("pos").to_numpy().astype(np.int64), t.column("component").to_numpy(), percent, test)
        return t.filter(pa.array(keep))

    return run


def _rest(percent: int, nearest: bool = False):
    """Pairs of a shard's lists that are not connected yet and that size, position and parity map do not rule out. A
    pair whose sets have an earlier list in common among their first HEAD is left to that list. nearest: only those
    with the nearest parity maps that a set meets in the shard."""

    def run(t: pa.Table) -> pa.Table:
        t = _sorted(t)
        tok, key, n, pos, group = (t.column(c).to_numpy() for c in ("tok", "x", "n", "pos", "component"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(tok), -1)
        head = [t.column(f"h{p}") for p in range(HEAD)]
        there = [h.is_valid().to_numpy() for h in head]
        head = [h.fill_null(0).to_numpy() for h in head]
        found = [np.empty((3, 0), np.int64)]

        def test(i: np.ndarray, j: np.ndarray) -> None:
            # sets differ in as many elements as their parity maps in bits, at least
            differ = np.concatenate([np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1).astype(np.int64) for a, b in ((i[c : c + 65536], j[c : c + 65536]) for c in range(0, len(i), 65536))])
            ok = (n[i] + n[j] - differ) // 2 >= _least(n[i], n[j], percent)
            i, j, differ = i[ok], j[ok], differ[ok]
            for a in range(HEAD):
                for b in range(HEAD):
                    if len(i):
                        before = (head[a][i] == head[b][j]) & there[a][i] & there[b][j] & (a < pos[i]) & (b < pos[j])
                        i, j, differ = i[~before], j[~before], differ[~before]
            if len(i):
                found.append(np.unique(np.stack([key[i], key[j], differ]), axis=1))

        _meet(tok, n, pos, group, percent, test)
        out = np.unique(np.concatenate(found, axis=1), axis=1)
        if nearest:
            end, pair = np.concatenate([out[0], out[1]]), np.tile(np.arange(out.shape[1]), 2)
            order = np.lexsort((out[2][pair], end))
            out = out[:, np.unique(pair[order[_runs(end[order])]])]
        return pa.table({"x": out[0], "y": out[1]})

    return run


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], names=["u", "v"])

    return run


def _may(percent: int):
    """Of pairs those that their long parity maps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = _least(b.column("xn").to_numpy(), b.column("yn").to_numpy(), percent)
            both = b.column("xn").to_numpy().astype(np.int64) + b.column("yn").to_numpy()
            differ = np.empty(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column("xmap"), b.column("ymap"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum()
            ok = pa.array((both - differ) // 2 >= least)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("x", "y", "times", "xrep", "yrep")], names=["x", "y", "times", "xrep", "yrep"])

    return run


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs of sets (x, y, times) those that may be linked, with a document of each (xrep, yrep)."""
    about = classes.select("key", "rep", "n", F.coalesce("long", "bits").alias("map"))
    for side in ("x", "y"):
        pairs = pairs.join(about.select(F.col("key").alias(side), F.col("rep").alias(f"{side}rep"), F.col("n").alias(f"{side}n"), F.col("map").alias(f"{side}map")), side)
    kind = dict(classes.dtypes)["rep"]
    return pairs.select("x", "y", "times", "xrep", "yrep", "xn", "yn", "xmap", "ymap").mapInArrow(_may(percent), f"x long, y long, times long, xrep {kind}, yrep {kind}")


def _marks(ids: DataFrame, n: int):
    """A filter that the n doc_ids of ids (doc_id) pass, and few others: the slot of a doc_id, and the bits by slot,
    broadcast; at most MARKS of them."""
    marks = 1 << max(16, (8 * n - 1).bit_length())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(marks))
    words = ids.withColumn("slot", slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word")).toArrow()
    held = np.zeros(marks >> 6, np.uint64)
    held[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return slot, ids.sparkSession.sparkContext.broadcast(held)


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs of sets (x, y), with a document of each (xrep, yrep), those that are linked (u, v), by their
    shingles."""
    need = pairs.select(F.col("xrep").alias("doc_id")).union(pairs.select(F.col("yrep").alias("doc_id"))).distinct()
    n = need.count()
    if 8 * n <= MARKS:  # texts do not travel: the tasks that read them make the sets
        slot, held = _marks(need, n)
        texts = docs.select("text", slot.alias("slot"))
    else:
        texts, held = docs.join(need.withColumnRenamed("doc_id", "wanted"), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text"), None

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if held is not None:
                at = b.column("slot").to_numpy()
                ok = held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
                b = b.filter(pa.array(ok.astype(bool)))
            for part in slices(iter([b]), size=CHUNK):
                found = list(sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "set"])

    # repeated doc_ids may have other texts: the digest tells which is meant
    written = table(texts.mapInArrow(own, "key long, set binary"), "join-sets")
    have = written.dropDuplicates(["key"])
    both = pairs.select("x", "y").join(have.select(F.col("key").alias("y"), F.col("set").alias("b")), "y").join(have.select(F.col("key").alias("x"), F.col("set").alias("a")), "x")
    out = table(both.select("x", "y", "a", "b").mapInArrow(_overlaps(percent), "u long, v long"), "join-links")
    drop(written)
    let_go(docs.sparkSession)
    return out


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles (distinct k-word shingles, A-Z lower-cased; with fewer words the whole
    sequence is one; 0 without words) and component_id, the smallest doc_id reachable by links. Two documents link
    when 100 * intersection >= percent * union; documents without words link with nothing.

    A null text has no words. Repeated doc_ids and rows are documents of their own that may link; a null doc_id has
    the smallest other doc_id of its component, null if there is none. An empty table gives no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs, parts = docs.select("doc_id", "text"), shards(spark)
    scan = table(docs.mapInArrow(_scan(k), f"kind int, doc_id {dict(docs.dtypes)['doc_id']}, n int, key long, bits binary, long binary, piece int, counts binary"), "join-scan")
    rows = scan.where("kind = 0").select("doc_id", "n", "key", "bits", "long")
    pieces = scan.where("kind = 1").select("piece", F.pmod("n", F.lit(64)).alias("task"), "counts")
    pieces = pieces.groupBy("piece", "task").applyInArrow(_add, "piece int, counts binary").groupBy("piece").applyInArrow(_add, "piece int, counts binary")
    counts = np.zeros(SKETCH, np.uint32)
    for r in pieces.collect():  # PIECES rows, SKETCH counters together
        size = SKETCH // PIECES
        counts[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), "<u4")
    sketch = spark.sparkContext.broadcast(counts)
    classes = table(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("long").alias("long")), "join-classes")
    packed = docs.mapInArrow(_prefixes(k, percent, parts, sketch), "shard int, data binary")
    lists = table(packed.groupBy("shard").applyInArrow(_lists(percent), "kind int, tok long, x long, y long, n int, pos int"), "join-lists")
    # one check for each set, against the leader that it meets most often among those that parity maps leave
    first = likely(lists.where("kind = 1").groupBy("y", "x").agg(F.sum("n").alias("times")), classes, percent)
    first = first.groupBy("y").agg(F.max_by(F.struct("x", "xrep", "yrep"), F.struct("times", "x")).alias("best"))
    links = linked(table(first.select("best.x", "y", "best.xrep", "best.yrep"), "join-first"), docs, k, percent)
    group = components(links)
    entries = lists.where("kind = 0").select("tok", "x", "n", "pos").join(group.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    entries = entries.withColumn("shard", F.pmod(F.xxhash64("tok"), F.lit(4 * parts))).select("shard", "tok", "x", "n", "pos", "component")
    live = table(entries.groupBy("shard").applyInArrow(_live(percent), entries.schema), "join-live")
    drop(lists)
    heads = live.where(F.col("pos") < HEAD).groupBy("x").agg(*(F.max(F.when(F.col("pos") == p, F.col("tok"))).alias(f"h{p}") for p in range(HEAD)))
    about = live.select("x").distinct().join(classes.select(F.col("key").alias("x"), "bits"), "x").join(heads, "x", "left")
    known = table(live.join(about, "x").select("shard", "tok", "x", "n", "pos", "bits", *(f"h{p}" for p in range(HEAD))), "join-known")
    # each set against the nearest that it meets, and then all pairs that are not connected by that
    for nearest in (True, False):
        now = known.join(group.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        rest = now.groupBy("shard").applyInArrow(_rest(percent, nearest), "x long, y long").distinct().withColumn("times", F.lit(1).cast("long"))
        more = linked(table(likely(rest, classes, percent).select("x", "y", "xrep", "yrep"), "join-rest"), docs, k, percent)
        links = links.unionByName(more)
        if nearest:
            group = components(links)
    group = components(links)
    named = group.join(classes.select(F.col("key").alias("node"), "rep"), "node")
    roots = named.groupBy("component").agg(F.min("rep").alias("least"))
    whole = classes.select("key", "rep").join(group.withColumnRenamed("node", "key"), "key", "left").join(roots, "component", "left").select(F.col("key").alias("k"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))
    return out.join(whole, F.col("key") == F.col("k"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_set_join(spark, sf_dir):
    """Shingle counts and components of all documents by 3-word shingles with Jaccard similarity 0.9 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


#: The same rows in SQL, for unique doc_ids: all pairs that share a shingle, then what links lead to.
ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM cut)),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reached r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id
"""
