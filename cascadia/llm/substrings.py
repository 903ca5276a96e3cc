"""Removal of passages that repeat across documents, by compressed FM-indexes per shard.

A document is cut into segments: runs of windows (of `window` words) with one minimizer, the smallest hash of the
runs of ANCHOR words in them. Equal windows have equal minimizers, so a shard has all segments with its minimizers, and
every two equal windows meet in one shard. A first pass sends the minimizers alone, half hashed, and finds those that
one document alone has; their segments hold no repeat and stay behind. In a shard the others, each distinct one once,
are indexed, and all of them are streamed against the index. Backward search over its wavelet matrix gives their
matching statistics; a window's match of full length leads to the smallest document that has it.

Between tasks minimizers and segments travel packed, many to a row, the words as codes of a dictionary, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.llm.fm_index import FMIndex
from cascadia.llm.store import shards
from cascadia.llm.words import _INV, _POW, cut, mix, slices

WINDOW, ANCHOR = 13, 5
#: Windows of a segment at most; longer runs go on in the next one.
LONGEST = 32
#: Word codes that a task gathers before it hands segments on.
BUFFER = 6 << 20
_LAST = (1 << 63) - 1


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values."""
    size, out = 1, a
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - size : len(a) - size + 1]) if width > size else out


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch of words follows, within a chunk of _POW's length."""
    return np.r_[np.uint64(0), np.cumsum(h * _POW[: len(h)])]


def segments(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word in the document, windows, minimizer) of every segment; h: the words' hashes."""
    n = np.diff(first)
    a = mix(h.copy(), 31)
    for i in range(1, ANCHOR):  # hashes of ANCHOR words; those over a document's end are never in a window
        nxt = np.r_[h[i:], np.zeros(min(i, len(h)), np.uint64)]
        a = mix(a * np.uint64(0x9E3779B97F4A7C15) + nxt, i)
    if len(h) < window:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    low = _sliding_min(a, window - ANCHOR + 1)
    doc = np.repeat(np.arange(len(n)), n)[: len(low)]
    pos = np.arange(len(low)) - first[doc]
    real = pos + window <= n[doc]
    at, low, doc, pos = np.flatnonzero(real), low[real], doc[real], pos[real]
    if not len(at):
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]
    run = np.flatnonzero(new)
    in_run = np.arange(len(low)) - np.repeat(run, np.diff(np.r_[run, len(low)]))
    run = np.flatnonzero(in_run % LONGEST == 0)
    return doc[run], pos[run], np.diff(np.r_[run, len(low)]), low[run]


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw = b"".join([head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


#: Of distinct segments: hash, windows; of occurrences: segment, document, its text's hash, first word; then
#: the dictionary and the words' codes in it.
_KINDS = [np.uint64, np.int32, np.int32, np.int64, np.int64, np.int32, np.uint64, np.int32]


def _named(docs: DataFrame) -> DataFrame:
    """_text tells apart texts under one doc_id, so that a null or repeated one is no hot key."""
    return docs.withColumn("_text", F.xxhash64("text"))


def _same(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined with found (doc_id, the largest long for null, and _text)."""
    found = found.withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    return docs.join(found, (F.coalesce(F.col("doc_id"), F.lit(_LAST)) == F.col("_id")) & (F.col("_text") == F.col("_hash")), how).drop("_id", "_hash")


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _half(anchor: np.ndarray) -> np.ndarray:
    """32 bits of a minimizer other than those that choose its shard; two that share them are kept without need."""
    return (mix(anchor, 35) >> np.uint64(32)).astype(np.uint32)


def _anchors(window: int, parts: int):
    """Packed (half a minimizer, document) by shard, each pair once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, docs = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            anchor, doc, ids, own_text = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (mix(anchor, 32) % np.uint64(parts)).astype(np.int64)
            half = _half(anchor)
            order = np.lexsort((doc, shard))
            edges = np.searchsorted(shard[order], np.arange(parts + 1))
            at, data = [], []
            for p in range(parts):
                own = order[edges[p] : edges[p + 1]]
                if len(own):
                    pairs = np.unique(doc[own].astype(np.int64) << 32 | half[own])
                    d = pairs >> 32
                    there, n = np.unique(d, return_counts=True)
                    at.append(p)
                    data.append(_pack(ids[there], own_text[there], n.astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])
            held.clear()

        for b in slices(batches):
            w = cut(b.column("text"))
            doc, _, _, low = segments(w.hashes()[0], w.first, window)
            held.append((low, doc + docs, _ids(b.column("doc_id")), b.column("_text").to_numpy()))
            words, docs = words + len(w.starts), docs + b.num_rows
            if words > 2 * BUFFER:
                yield from flush()
                words = docs = 0
        yield from flush()

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Of a shard's minimizers those that two doc_ids or more have: doc_id, _text, halves (a document's own, packed)."""
    cols = [_unpack(x, [np.int64, np.int64, np.int32, np.uint32]) for x in t.column("data").to_pylist()]
    ids, texts, n, half = (np.concatenate([c[i] for c in cols]) for i in range(4))
    of = np.repeat(np.arange(len(ids)), n)
    order = np.argsort(half, kind="stable")
    start = np.flatnonzero(np.r_[True, half[order][1:] != half[order][:-1]]) if len(half) else np.empty(0, np.int64)
    low, high = (f.reduceat(ids[of[order]], start) if len(start) else ids[:0] for f in (np.minimum, np.maximum))
    keep = order[np.repeat(low < high, np.diff(np.r_[start, len(half)]))]
    keep = keep[np.lexsort((half[keep], of[keep]))]
    have, first = np.unique(of[keep], return_index=True)
    data = [x.tobytes() for x in np.split(half[keep], first[1:])] if len(have) else []
    return pa.table({"doc_id": pa.array(ids[have], pa.int64()), "_text": pa.array(texts[have], pa.int64()), "halves": pa.array(data, pa.binary())})


def _cut_up(window: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, seg, marks, ids = (np.concatenate(x) if x[0].ndim == 1 else np.concatenate(x, axis=1) for x in zip(*held, strict=True))
            if not seg.shape[1]:
                held.clear()
                return
            start, count, anchor, key, doc = seg[0].astype(np.int64), seg[1].astype(np.int64), seg[2], seg[3], seg[4].astype(np.int64)
            begin = seg[5].astype(np.int64)
            word, code = np.unique(h, return_inverse=True)
            code = code.astype(np.int32)
            local = np.empty(len(word), np.int32)
            shard = (mix(anchor, 32) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key, shard))
            edges = np.searchsorted(shard[order], np.arange(parts + 1))
            at, data = [], []
            for p in range(parts):
                own = order[edges[p] : edges[p + 1]]
                if not len(own):
                    continue
                fresh = np.r_[True, key[own][1:] != key[own][:-1]]
                of = np.cumsum(fresh) - 1
                rep = own[fresh]
                length = count[rep] + window - 1
                ends = np.cumsum(length)
                codes = code[np.arange(ends[-1]) + np.repeat(start[rep] - (ends - length), length)]
                used = np.unique(codes)
                local[used] = np.arange(len(used), dtype=np.int32)
                at.append(p)
                data.append(_pack(key[rep], count[rep].astype(np.int32), of.astype(np.int32), ids[doc[own]], marks[doc[own]], begin[own].astype(np.int32), word[used], local[codes]))
                if sum(map(len, data)) > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])
                    at, data = [], []
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])
            held.clear()

        words = docs = 0
        for b in slices(batches):
            w = cut(b.column("text"))
            h = w.hashes()[0]
            doc, pos, count, low = segments(h, w.first, window)
            halves = [np.frombuffer(b"".join(x or ()), np.uint32) for x in b.column("_halves").to_pylist()]
            wanted = np.concatenate([np.int64(d) << 32 | x.astype(np.int64) for d, x in enumerate(halves)]) if halves else np.empty(0, np.int64)
            some = np.isin(doc << 32 | _half(low).astype(np.int64), wanted)
            doc, pos, count, low = doc[some], pos[some], count[some], low[some]
            s = w.first[doc] + pos
            key = _stretches(h, s, s + count + window - 1)
            ids = _ids(b.column("doc_id"))
            marks = b.column("_text").to_numpy()
            held.append((h, np.stack([(s + words).astype(np.uint64), count.astype(np.uint64), low, key, (doc + docs).astype(np.uint64), pos.astype(np.uint64)]), marks, ids))
            words, docs = words + len(h), docs + b.num_rows
            if words > BUFFER:
                yield from flush()
                words = docs = 0
        yield from flush()

    return run


def _stretches(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words s to e; they depend on the words alone."""
    out, step = np.empty(len(s), np.uint64), len(_POW) - 1
    longest = int((e - s).max(initial=0))
    at = 0
    while at < len(s):
        base = int(s[at])
        upto = int(np.searchsorted(s, base + step - longest))
        upto = max(upto, at + 1)
        sums = _sums(h[base : int(e[at:upto].max())])
        out[at:upto] = mix((sums[e[at:upto] - base] - sums[s[at:upto] - base]) * _INV[s[at:upto] - base] + (e - s)[at:upto].astype(np.uint64), 33)
        at = upto
    return out


def _search(window: int):
    """Of a shard the words to remove: doc_id, _text, from, to (word numbers in the document)."""

    def run(t: pa.Table) -> pa.Table:
        cols = [_unpack(x, _KINDS) for x in t.column("data").to_pylist()]
        shift = np.cumsum([0, *(len(c[0]) for c in cols)])
        key, count = (np.concatenate([c[i] for c in cols]) for i in (0, 1))
        of = np.concatenate([c[2].astype(np.int64) + s for c, s in zip(cols, shift, strict=False)])
        doc, marks, begin = (np.concatenate([c[i] for c in cols]) for i in (3, 4, 5))
        # each distinct segment once, with its smallest document
        _, rep, same = np.unique(key, return_index=True, return_inverse=True)
        seg = same[of]
        least = np.full(len(rep), _LAST)
        np.minimum.at(least, seg, doc)
        words = np.unique(np.concatenate([c[6] for c in cols]))
        texts = []
        for c, s in zip(cols, shift, strict=False):
            length = c[1].astype(np.int64) + window - 1
            ends = np.cumsum(length)
            mine = np.flatnonzero((rep >= s) & (rep < s + len(length)))
            i = rep[mine] - s
            n = length[i] + 1
            stop = np.cumsum(n)
            place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n, n) + np.repeat(ends[i] - length[i], n)
            inner = np.ones(len(place), bool)
            inner[stop - 1] = False
            out = np.zeros(len(place), np.int64)
            out[inner] = np.searchsorted(words, c[6])[c[7][place[inner]]] + 1
            texts.append((mine, n, out))
        owner = np.concatenate([x[0] for x in texts])
        length = np.concatenate([x[1] for x in texts])
        text = np.concatenate([x[2] for x in texts])
        start = np.cumsum(length) - length
        index = FMIndex(text, len(words) + 1, window, least[np.repeat(owner, length)])
        place, row = index.matches(start, length - 1, text)
        # the smallest document of every window of every segment, in the order of the text
        found = np.full(len(text), _LAST)
        found[place] = index.least[index.group(row)]
        where = np.empty(len(rep), np.int64)
        where[owner] = start
        some = least[seg] < doc  # the whole segment stands in a smaller document: no need to look at its windows
        windows = count[rep].astype(np.int64)[seg]
        hard = np.flatnonzero(~some)
        n = windows[hard]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        of = np.repeat(hard, n)
        gone = found[where[seg[of]] + at] < doc[of]
        edge = np.flatnonzero(gone & np.r_[True, (of[1:] != of[:-1]) | ~gone[:-1]]) if len(of) else np.empty(0, np.int64)
        last = np.flatnonzero(gone & np.r_[(of[1:] != of[:-1]) | ~gone[1:], True]) if len(of) else np.empty(0, np.int64)
        whole = np.flatnonzero(some)
        which = np.concatenate([whole, of[edge]])
        first = np.concatenate([begin[whole], begin[of[edge]] + at[edge]])
        to = np.concatenate([begin[whole] + windows[whole], begin[of[last]] + at[last] + 1]) + window - 1
        return pa.table({"doc_id": pa.array(doc[which]), "_text": pa.array(marks[which]), "from": pa.array(first.astype(np.int32)), "to": pa.array(to.astype(np.int32))})

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id (the largest long for null), _text (the text's xxhash64), from, to: stretches of words covered by windows
    that also start in a document with a smaller doc_id."""
    parts = 2 * shards(docs.sparkSession)
    texts = _named(docs.select("doc_id", "text"))
    first = texts.mapInArrow(_anchors(window, parts), "shard int, data binary").groupBy("shard").applyInArrow(_repeated, "doc_id long, _text long, halves binary")
    first = first.groupBy("doc_id", "_text").agg(F.collect_set("halves").alias("_halves"))
    some = _same(texts, first, "inner").select("doc_id", "text", "_text", "_halves")
    packed = some.mapInArrow(_cut_up(window, parts), "shard int, data binary")
    return packed.groupBy("shard").applyInArrow(_search(window), "doc_id long, _text long, from int, to int")


def _kept(words: list[bytes], spans: list) -> list[bytes]:
    if not spans:
        return words
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["from"] : s["to"]] = False
    return list(compress(words, keep.tolist()))


def with_kept(docs: DataFrame, found: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """docs with their stretches, and for each row make(text bytes, words, kept words) as further columns."""
    spans = found.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("from", "to")).alias("_spans"))
    joined = _same(_named(docs), spans, "left").drop("_text")
    kinds, own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                data = (text or "").encode()
                words = data.split()
                rows.append(make(text, words, _kept(words, spans)))
            made = [list(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), *map(pa.array, made)], names=[*own, *names])

    return joined.mapInArrow(run, ", ".join([*kinds, schema]))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by single spaces).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A null or empty text has none. Documents with one doc_id do
    not remove each other's words; a null doc_id counts as the largest. Repeated rows are rows of the result. An
    empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")

    def make(text, words, kept):
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    out = with_kept(docs, repeats(docs, window), make, "n_words long, n_removed long, kept_sha256 string", ["n_words", "n_removed", "kept_sha256"])
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_substrings(spark, sf_dir):
    """What is left of all documents without the 13-word windows that a document with a smaller doc_id has too."""
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in SQL, for unique doc_ids: the smallest document of every window.
ORACLE = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM cut)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM late CROSS JOIN (SELECT unnest(range(13)) AS o)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS left_over, count(*) AS n FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT c.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON k.doc_id = c.doc_id
"""
