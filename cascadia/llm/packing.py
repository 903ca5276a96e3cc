"""Best-fit packing of token sequences by exact-complement hashing.

How pieces share sequences depends on their lengths only, so the plan is made from one count per length (as many as a
sequence has tokens, whatever the input) and then dealt out to the pieces by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadia.llm.store import table
from cascadia.llm.words import slices

LIMIT, END = 1024, 2
#: Texts with this code point or a later one are left to the tokenizer itself.
PLAIN = 0x240
#: White space below it.
SPACE = r"\t-\r \x85\xa0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as the tokenizer file defines them. Texts of Latin letters without a special token's
    string go to a faster merger over the file's own vocabulary; the others to the tokenizer itself, as do all texts
    where the file normalises, splits otherwise than byte-level files do, or numbers its merges in another order.

    The file's pattern looks ahead after white space; texts are cut where that matters instead, before the last of
    two or more white spaces that something follows, and the pattern without it gives the same parts."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        file = json.loads(self.tokenizer.to_str())
        split, model = file["pre_tokenizer"] or {}, file["model"]
        known = file["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and model["type"] == "BPE"
        known = known and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.fast = None
        if not known:
            return
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [self.tokenizer.token_to_id(a + b) for a, b in merges]
        code, vocabulary = _byte_letters(), {t: n for t, n in self.tokenizer.get_vocab().items() if t not in self.special}
        if order != sorted(order) or not all(x in code for token in vocabulary for x in token):
            return
        ranks = {bytes(code[x] for x in token): n for token, n in vocabulary.items()}
        self.fast = tiktoken.Encoding("parts", pat_str=r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.runs = re.compile(rf"[{SPACE}]{{2}}[^{SPACE}]")
        self.cut = re.compile(rf"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

    def encode(self, text: str, plain: bool) -> list[int]:
        """plain: the text has no code point from PLAIN on."""
        if self.fast is None or not plain or any(x in text for x in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.runs.search(text):
            return [n for part in self.cut.split(text) for n in self.fast(part)]
        return self.fast(text)


def plain(texts: pa.Array) -> np.ndarray:
    """Whether each text has code points below PLAIN only, by the largest of its UTF-8 bytes."""
    out = np.ones(len(texts), bool)
    for i, x in enumerate(texts.cast(pa.large_binary())):
        data = x.as_buffer()
        if data is not None and data.size:
            out[i] = np.frombuffer(data, np.uint8).max() < 0xC9
    return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and place: the task and the piece's number among those of its
    length there."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for b in slices(batches):
            rows, doc = [], []
            for d, (text, easy) in enumerate(zip(b.column("text").to_pylist(), plain(b.column("text")), strict=True)):
                own = np.array([*coder.encode(text or "", easy), end], "<u4")
                n = -(-len(own) // limit)
                edges = [0, *(len(own) - limit * k for k in range(n - 1, -1, -1))]
                for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((i, s, e - s, zlib.crc32(own[s:e].tobytes()), part, seen[e - s]))
                    doc.append(d)
                    seen[e - s] += 1
            cols = np.array(rows, np.int64).T
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), *(pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Sums:
    """Index of the sums of two and of three available lengths, up to limit. pairs[s]: the shorter lengths of pairs with
    sum s, most even first; triples[s]: the lengths, longest first, that with a pair of the rest's sum make s."""

    def __init__(self, counts: np.ndarray, limit: int):
        there = np.flatnonzero(counts)
        i, j = np.triu_indices(len(there))
        total = there[i] + there[j]
        fits = total <= limit
        short, total = there[i][fits], total[fits]
        order = np.lexsort((-short, total))
        self.pairs = np.split(short[order], np.searchsorted(total[order], np.arange(1, limit + 1)))
        paired = np.array([len(x) > 0 for x in self.pairs])
        longest = there[::-1]
        self.triples = [own[paired[s - own]] for s in range(limit + 1) for own in (longest[longest < s],)]


    def open_pairs(self, total: int, counts: np.ndarray) -> np.ndarray:
        """The pairs with this sum of which counts has both lengths."""
        a = self.pairs[total]
        return a[(counts[a] > 0) & (counts[total - a] > 0)]


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences). counts[n]: pieces of length n.

    The longest lengths first: gaps are filled exactly by one length, by two, then by three, from an index of their
    sums, as far as the counts go; what is left goes by best fit, longest first. Each step uses up a length or a kind
    of open sequence, so that the plan's size depends on limit alone.
    """
    c = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        times = min(int(c[n]) // k for n, k in Counter(lengths).items())
        if times:
            for n in lengths:
                c[n] -= times
            out.append((lengths, times))
        return times > 0

    sums = Sums(c, limit)
    for n in range(limit, 0, -1):
        gap = limit - n
        if not c[n]:
            continue
        if not gap:
            use(n)
            continue
        use(n, gap)
        for a in sums.open_pairs(gap, c):
            if not c[n]:
                break
            use(n, int(gap - a), int(a))
        for a in sums.triples[gap]:
            if not c[n]:
                break
            if c[a]:
                for b in sums.open_pairs(gap - a, c):
                    if not c[n] or not c[a]:
                        break
                    use(n, int(a), int(gap - a - b), int(b))
    free: dict[int, list[list]] = {}  # open sequences by room: [lengths, how many]
    for n in range(limit, 0, -1):
        while c[n]:
            room = min((r for r in free if r >= n), default=None)
            if room is None:
                per = min(limit // n, int(c[n]))
                times = int(c[n]) // per
                c[n] -= times * per
                free.setdefault(limit - per * n, []).append([(n,) * per, times])
                continue
            lengths, times = free[room].pop()
            took = min(times, int(c[n]))
            c[n] -= took
            if took < times:
                free[room].append([lengths, times - took])
            if not free[room]:
                del free[room]
            free.setdefault(room - n, []).append([(*lengths, n), took])
    return out + [(tuple(lengths), times) for kinds in free.values() for lengths, times in kinds]


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Per piece of a document's ids (the tokenizer's, then end): doc_id, piece, start, length, ids_crc32, sequence_id
    and offset.

    A null text is an empty one and has the end id alone. Repeated doc_ids and rows are documents of their own. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = table(pieces(docs, tokenizer or default_tokenizer(), limit, end), "pack-pieces")
    by = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most limit rows
        counts[r["length"]] = r["n"]
    starts, seqs, offsets, used, seq = [], [], [], np.zeros(limit + 1, np.int64), 0
    for lengths, times in plan(counts, limit):
        at = 0
        for n in lengths:
            starts.append((n << 48) + int(used[n]))
            seqs.append(seq)
            offsets.append(at)
            used[n] += times
            at += n
        seq += times
    order = np.argsort(np.array(starts, np.int64))
    starts, seqs, offsets = (np.array(x, np.int64)[order] for x in (starts, seqs, offsets))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    ranked = rows.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(x).to_numpy() for x in ("length", "rank"))
            key = (length << 48) + rank
            i = np.searchsorted(starts, key, "right") - 1
            columns = [*b.columns[:5], pa.array(seqs[i] + key - starts[i]), pa.array(offsets[i])]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:5], "sequence_id", "offset"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def op2_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
