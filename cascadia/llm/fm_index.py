"""An FM-index over integer sequences: a wavelet matrix with packed bits under the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector: how many of its first bits are set."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Counts of a symbol in any prefix of a sequence, for many symbols and prefixes at a time."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        self.bits = max(1, int(symbols - 1).bit_length())
        seq = seq.astype(np.int32)
        first = np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        for b in range(self.bits - 1, -1, -1):
            one = (seq >> b) & 1 == 1
            self.levels.append((Bits(one), int(len(seq) - one.sum())))
            first = self._down(first, (every >> b) & 1 == 1, self.levels[-1])
            seq = np.concatenate([seq[~one], seq[one]])
        self.first = first

    @staticmethod
    def _down(i: np.ndarray, one: np.ndarray, level) -> np.ndarray:
        bits, zeros = level
        ones = bits.rank(i)
        return np.where(one, zeros + ones, i - ones)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i symbols."""
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            i = self._down(i, (c >> b) & 1 == 1, level)
        return i - self.first[c]


class FMIndex:
    """An index of text (symbols from 1; 0 ends each piece) whose suffixes are sorted by their first depth symbols.

    That is as far as matching statistics up to depth need: the rows that start with a string of at most depth symbols
    are adjacent, and extending a string of fewer than depth symbols to the left is exact.

    What stays is the wavelet matrix, two bits a row that mark where groups of equal strings of depth and depth - 1
    symbols begin, and a few numbers a group, no suffix array; values (one for each place of the text) are kept as
    least, each group's smallest. keep: the suffixes stay too."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, values: np.ndarray | None = None, keep: bool = False):
        self.depth, self.n = depth, len(text)
        ranks = {1: text.astype(np.int64)}
        size = 1
        while size * 2 <= depth:
            ranks[2 * size] = self._pair(ranks[size], size)
            size *= 2
        one_less = ranks[size] if size == depth - 1 else self._pair(ranks[size], depth - 1 - size)
        full = ranks[size] if size == depth else self._pair(ranks[size], depth - size)
        suffixes = np.argsort(full, kind="stable")
        fresh = lambda x: np.r_[True, x[1:] != x[:-1]]
        groups, parents = fresh(full[suffixes]), fresh(one_less[suffixes])
        del ranks, full, one_less
        self.groups, self.parent_of = Bits(groups), Bits(parents)
        self.parents = np.r_[np.flatnonzero(parents), self.n]
        if values is not None:
            self.least = np.minimum.reduceat(values[suffixes], np.flatnonzero(groups))
        if keep:
            self.suffixes = suffixes
        self.wavelets = WaveletMatrix(text[suffixes - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]

    @staticmethod
    def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by a suffix's own rank, then by that of the one shift further on; past the end is lowest."""
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - shift] = rank[shift:]
        return np.unique(rank * (int(rank.max(initial=0)) + 2) + later + 1, return_inverse=True)[1]

    def group(self, row: np.ndarray) -> np.ndarray:
        """The group of each row, by its first depth symbols."""
        return self.groups.rank(row + 1) - 1

    def matches(self, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of pieces of text, cut off at depth: for every place of a piece whose match with the
        index has depth symbols, (the place in text, a row of the index with that match).

        All pieces are read backwards together. A match of depth symbols is shortened to its parent, one symbol less,
        before the next symbol is put in front of it."""
        many = len(start)
        lo, hi, size = np.zeros(many, np.int64), np.full(many, self.n, np.int64), np.zeros(many, np.int64)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        places, rows = [], []
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, "left"))  # pieces longer than t
            at = start[:live] + length[:live] - 1 - t
            c = text[at]
            a, b, m = lo[:live], hi[:live], size[:live]
            full = np.flatnonzero(m == self.depth)
            p = self.parent_of.rank(a[full] + 1) - 1
            a[full], b[full], m[full] = self.parents[p], self.parents[p + 1], self.depth - 1
            a[:] = self.before[c] + self.wavelets.rank(c, a)
            b[:] = self.before[c] + self.wavelets.rank(c, b)
            lost = b <= a
            if lost.any():  # not in the index with what follows: begin anew with this symbol, if it is there
                a[lost], b[lost] = self.before[c[lost]], self.before[c[lost] + 1]
                m[lost] = np.where(b[lost] > a[lost], 0, -1)
                empty = b <= a
                a[empty], b[empty] = 0, self.n
            m += 1
            done = m == self.depth
            places.append(at[done])
            rows.append(a[done])
        return (np.concatenate(places), np.concatenate(rows)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))
