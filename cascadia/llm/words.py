"""Whole texts of an Arrow batch cut into words and hashed with numpy, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; temporary arrays are about 40 times this.
CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(CHUNK + 1, _BASE), _powers(CHUNK + 1, _INVERSE)


@dataclass
class Words:
    """data: the batch's bytes; starts, ends: of every word in it; first[d]:first[d + 1] are document d's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, limits: tuple[int | None, ...] = (None,)) -> list[np.ndarray]:
        """For each limit a 64-bit hash of each word's first bytes, at most so many (None: all)."""
        outs = [np.empty(len(self.starts), np.uint64) for _ in limits]
        i = 0
        while i < len(self.starts):
            at = self.starts[i]
            j = int(np.searchsorted(self.ends, at + CHUNK, "right"))
            if j <= i:  # one word longer than a chunk
                for out, limit in zip(outs, limits, strict=True):
                    out[i] = self._long(at, self.ends[i] if limit is None else min(self.ends[i], at + limit))
                i += 1
                continue
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            total = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(_BYTE[self.data[at : at + e[-1]]] * _POW[: e[-1]], out=total[1:])
            for out, limit in zip(outs, limits, strict=True):
                to = e if limit is None else np.minimum(e, s + limit)
                out[i:j] = mix((total[to] - total[s]) * _INV[s])
            i = j
        return outs

    def _long(self, s: int, e: int) -> np.uint64:
        h = 0
        for k in range(s, e, CHUNK):
            part = self.data[k : min(e, k + CHUNK)]
            h = (h + int((_BYTE[part] * _POW[: len(part)]).sum()) * pow(_BASE, k - s, 1 << 64)) % (1 << 64)
        return mix(np.array([h], np.uint64))[0]


def cut(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D; null texts have none. lower: A-Z become a-z."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    full = ~_SPACE[raw]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    inner = np.unique(at[(at > 0) & (at < len(raw))])
    begin[inner] |= full[inner]
    end[inner - 1] |= full[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(_LOWER[raw] if lower else raw, starts, ends, np.searchsorted(starts, at))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about size bytes of text, a document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def shingles(w: Words, h: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and each document's bounds in them. whole: a document with fewer words, but
    one at least, has one shingle of all its words."""
    n = w.counts
    many = np.maximum(n - k + 1, (n > 0).astype(n.dtype) if whole else 0)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], many)
    if not len(at):
        return np.empty(0, np.uint64), first
    stop = np.repeat(w.first[1:], many)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        there = at + i < stop
        out = mix(out * np.uint64(_BASE) + np.where(there, h[np.minimum(at + i, len(h) - 1)], np.uint64(0)), i)
    return out, first
