"""Toxicity of whole texts by a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of those of its first 4 and first 6 bytes, which new
forms of known words share. Filters of several widths run over the whole text, their largest values are pooled, and a
logistic output gives the score. Embeddings start from the features' log-odds over all training rows. All labelled
rows take part: four in five doc_ids train, the fifth sets the lines between the classes, over all and by language.
Rows are dealt into shards of bounded size; in each round a task passes over a shard from the same model and the means
of what shards have changed make the next one. Sums are of whole numbers, so that their order does not matter. The
driver gets sums and the model alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.functions.prefix import prefix
from cascadia.llm.store import drop, table
from cascadia.llm.words import CHUNK, cut, slices

FEATURES, DIMS, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 10
LIMITS = (None, 4, 6)
#: Labelled rows and UTF-8 bytes of a shard, about; tasks that write shards.
ROWS, BYTES, TASKS = 2500, 16 << 20, 4096
#: Rows that training passes over, in whole epochs between the two numbers given.
PASSES, EPOCHS, RATE = 12_000, (3, 30), 0.08
#: Rows and words of a step: a row at least.
STEP, WORDS = 64, 1 << 18
#: The exponents of least and most bits of a table that says which doc_ids are labelled; the least one is Spark's.
BITS = 15, 26
#: Words whose changes make a row, and the units that changes of embeddings and of all else are counted in.
BLOCK, UNIT, FINE = 1 << 12, 2.0**-20, 2.0**-40
#: Examples of each class that a threshold of its own takes.
ENOUGH = 10


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, len(LIMITS)): each word's rows in the embeddings; each text's bounds in them."""
    w = cut(texts, lower=True)
    hashes = w.hashes(LIMITS)
    return np.stack([((h + np.uint64(i * 0x51ED270B)) % np.uint64(FEATURES)).astype(np.int32) for i, h in enumerate(hashes)], axis=1), w.first


@dataclass
class Model:
    words: np.ndarray
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict | None = None

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: bool = False):
        """(texts, filters): the largest response of each filter, 0 at least; with places, where it is (-1: none)."""
        n = len(first) - 1
        count = np.diff(first)
        x = self.words[ids[:, 0]] + self.words[ids[:, 1]] + self.words[ids[:, 2]]
        left = np.repeat(first[1:], count) - np.arange(len(x))  # words up to the text's end
        some = np.flatnonzero(count > 0)
        best, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        for k, width in enumerate(WIDTHS):
            z = x @ self.filters[k][0] + self.bias[k]
            for o in range(1, width):
                z[:-o] += (x[o:] @ self.filters[k][o]) * (left[:-o] > o)[:, None]
            if len(some):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                top = np.maximum.reduceat(z, first[some])
                best[some, own] = np.maximum(top, 0)
                if places:
                    at, col = np.nonzero(z == np.repeat(np.where(top > 0, top, np.inf), count[some], axis=0))
                    at, col = at[::-1], col[::-1]  # the first place is written last
                    where[np.searchsorted(first, at, "right") - 1, own.start + col] = at
        return (best, where, x, left) if places else best

    def margins(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (self.pooled(ids, first) @ self.out[:-1] + self.out[-1]).astype(float)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.margins(*features(texts)) + self.shift)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def start(seen: np.ndarray, totals: tuple[int, int], seed: int = 3) -> tuple[Model, dict]:
    """A model to train and its sums of squared steps. seen (2, FEATURES): toxic and other training rows with each
    feature; totals: all of them."""
    rng = np.random.default_rng(seed)
    odds = np.log((seen[0] + 0.5) / (max(1, totals[0]) + 1)) - np.log((seen[1] + 0.5) / (max(1, totals[1]) + 1))
    odds = np.where(seen.sum(axis=0) >= 4, np.clip(odds, -3, 3), 0)
    words = rng.normal(0, 0.05, (FEATURES, DIMS)).astype(np.float32)
    words[:, 0] = odds / 3
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 0.5
    m = Model(words, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.append(np.full(len(WIDTHS) * FILTERS, 0.1), -1.0).astype(np.float32))
    return m, {k: np.full((FEATURES, 1) if k == "words" else x.shape, 1e-2) for k, x in _parts(m).items()}


def _parts(m: Model) -> dict[str, np.ndarray]:
    return {"words": m.words, "out": m.out} | {f"f{k}": x for k, x in enumerate(m.filters)} | {f"b{k}": x for k, x in enumerate(m.bias)}


def _spans(ids: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some texts and each one's bounds in them."""
    bounds = np.concatenate([[0], np.cumsum(first[some + 1] - first[some])])
    return ids[np.arange(bounds[-1]) + np.repeat(first[some] - bounds[:-1], np.diff(bounds))], bounds


def _steps(order: np.ndarray, count: np.ndarray, rows: int = STEP) -> Iterator[np.ndarray]:
    """All rows in this order, so many at a time, and fewer where they have many words."""
    for some in np.array_split(order, max(1, -(-len(order) // rows))):
        group = (np.cumsum(count[some]) - count[some]) // WORDS
        yield from (np.sort(x) for x in np.split(some, np.flatnonzero(np.diff(group)) + 1) if len(x))


def train(m: Model, state: dict, ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, weights: tuple[float, float], passes: int, rng) -> None:
    """Passes over all of these rows, that change the model and its sums. weights: of other and of toxic rows."""
    parts, count, toxic = _parts(m), np.diff(first), toxic.astype(float)
    weight = np.where(toxic == 1, weights[1], weights[0])

    def step(name: str, g: np.ndarray) -> None:
        state[name] += g * g
        value = parts[name]
        value -= (RATE * g / np.sqrt(state[name])).astype(value.dtype)

    for _ in range(passes):
        for some in _steps(rng.permutation(len(toxic)), count):
            mine, bounds = _spans(ids, first, some)
            best, where, x, left = m.pooled(mine, bounds, places=True)
            d = ((_logistic(best @ m.out[:-1] + m.out[-1]) - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            back = d[:, None] * m.out[:-1]
            step("out", np.append(best.T @ d, d.sum()) + 1e-4 * m.out)
            rows, grads = [], []
            for k, width in enumerate(WIDTHS):
                own_cols = slice(k * FILTERS, (k + 1) * FILTERS)
                t, f = np.nonzero(where[:, own_cols] >= 0)
                pos, g = where[:, own_cols][t, f], back[:, own_cols][t, f]
                gf, gb = np.zeros_like(m.filters[k]), np.zeros(FILTERS)
                np.add.at(gb, f, g)
                for o in range(width):
                    ok = left[pos] > o
                    np.add.at(gf[o].T, f[ok], g[ok, None] * x[pos[ok] + o])
                    rows.append(pos[ok] + o)
                    grads.append(g[ok, None] * m.filters[k][o][:, f[ok]].T)
                step(f"f{k}", gf + 1e-4 * m.filters[k])
                step(f"b{k}", gb)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            if len(rows):
                cells, back_to = np.unique(mine[rows].ravel(), return_inverse=True)
                total = np.zeros((len(cells), DIMS), np.float32)
                np.add.at(total, back_to, np.repeat(grads, mine.shape[1], axis=0))
                state["words"][cells] += (total * total).mean(axis=1, keepdims=True)
                m.words[cells] -= RATE * total / np.sqrt(state["words"][cells])


def _changes(old: tuple[Model, dict], new: tuple[Model, dict]) -> tuple[np.ndarray, np.ndarray]:
    """What training has changed, in whole units: of each word (embedding, sum, whether it was met), of all else."""
    (a, s), (b, t) = old, new
    words = np.concatenate([b.words.astype(float) - a.words, t["words"] - s["words"], (t["words"] != s["words"]) * UNIT], axis=1)
    x, y = _parts(a), _parts(b)
    rest = [(p[k].astype(float) - q[k]).ravel() for p, q in ((y, x), (t, s)) for k in x if k != "words"]
    return np.rint(words / UNIT).astype(np.int64), np.rint(np.concatenate([*rest, [FINE]]) / FINE).astype(np.int64)


def _changed(old: tuple[Model, dict], words: np.ndarray, rest: np.ndarray) -> tuple[Model, dict]:
    """The model with the mean of shards' summed changes: a word's over the shards that met it."""
    m, state = pickle.loads(pickle.dumps(old))
    if not rest[-1]:
        return m, state
    mean = words[:, :-1] * UNIT / np.maximum(words[:, -1:], 1)
    m.words += mean[:, :DIMS].astype(np.float32)
    state["words"] += mean[:, DIMS:]
    at, mean = 0, rest[:-1] * FINE / rest[-1]
    for values in (_parts(m), state):
        for k in (k for k in _parts(m) if k != "words"):
            values[k] += mean[at : at + values[k].size].reshape(values[k].shape).astype(values[k].dtype)
            at += values[k].size
    return m, state


def held_out(doc_id):
    """crc32 of the doc_id as text (null: the empty one) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: all labels that may be learned from."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _calibrates(doc_id):
    return F.pmod(F.xxhash64(F.lit("calibrates"), doc_id), F.lit(5)) == 0


def _likely(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, lang of all docs whose doc_id is one of some rows ids, and of few others, so that no more texts
    need to be moved. A table of bits by hash says which, in which others may share a bit."""
    bits = 1 << min(BITS[1], max(BITS[0], (16 * rows).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    low = F.lit((1 << BITS[0]) - 1).cast("long")
    parts = ids.select(place.alias("at")).groupBy(F.shiftright("at", BITS[0]).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(low)).alias("bits"))
    there = np.zeros((bits >> BITS[0], 1 << (BITS[0] - 3)), np.uint8)
    for r in parts.collect():
        there[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(there.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            yield b.drop_columns(["at"]).filter(pa.array((held.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    docs = docs.select("doc_id", "text", "lang")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.where(~held_out(F.col("doc_id"))).withColumn("at", place).mapInArrow(run, ", ".join(kinds))


def _shards(docs: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    """The features of all docs that have marks, a row for each shard: its number, features, words of each text,
    classes, calibrates and langs. Each doc_id's mark is sorted before its rows, so that texts move once."""

    def row(no: int, parts: list) -> pa.RecordBatch:
        ids, count, toxic, calibrates, langs = zip(*parts, strict=True)
        packed = [[no], *([np.concatenate(x).tobytes()] for x in (ids, count, toxic, calibrates)), [[y for x in langs for y in x]]]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, kinds, strict=True)], names=["shard", "ids", "words", "toxic", "calibrates", "langs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, name, mark = None, [], None, 0
        for b in slices(batches, size=CHUNK):
            ids, marks, no = b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("shard").to_numpy()
            toxic = np.full(len(ids), -1)
            for i, (x, y) in enumerate(zip(ids, marks, strict=True)):
                if y is not None:
                    name, mark = x, y
                elif x == name:
                    toxic[i] = mark
            own = np.flatnonzero(toxic >= 0)
            b, no, toxic = b.take(pa.array(own)), no[own], toxic[own]
            edges = [0, *(np.flatnonzero(np.diff(no)) + 1), len(no)] if len(no) else []
            for low, high in zip(edges, edges[1:], strict=False):
                if parts and now != no[low]:
                    yield row(now, parts)
                    parts = []
                now, own = int(no[low]), b.slice(low, high - low)
                found, first = features(own.column("text"))
                flags = own.column("calibrates").to_numpy(zero_copy_only=False).astype(np.uint8)
                parts.append((found.astype(np.uint16), np.diff(first).astype(np.int64), toxic[low:high].astype(np.uint8), flags, [x or "" for x in own.column("lang").to_pylist()]))
        if parts:
            yield row(now, parts)

    texts = docs.select("doc_id", "text", "lang", F.lit(None).cast("int").alias("mark"))
    both = texts.unionByName(marks.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("toxic").alias("mark")), allowMissingColumns=True)
    both = both.withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"), "calibrates": _calibrates("doc_id")})
    dealt = both.repartitionById(min(TASKS, shards), F.pmod("shard", F.lit(min(TASKS, shards))))
    ordered = dealt.sortWithinPartitions("shard", "doc_id", F.col("mark").desc_nulls_last(), "text", "lang")
    return ordered.mapInArrow(run, "shard int, ids binary, words binary, toxic binary, calibrates binary, langs array<string>")


def _unpacked(batches: Iterator[pa.RecordBatch], calibrates: bool) -> Iterator[tuple]:
    """For each shard of _shards() its number, and its training or calibrating texts' features, bounds, classes, langs."""
    for b in batches:
        for i in range(b.num_rows):
            no, ids, count, toxic, flag = (b.column(c)[i] for c in ("shard", "ids", "words", "toxic", "calibrates"))
            ids = np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, len(LIMITS)).astype(np.int32)
            count, toxic, flag = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((count, np.int64), (toxic, np.uint8), (flag, np.uint8)))
            own = np.flatnonzero(flag == calibrates)
            if len(own):
                langs = b.column("langs")[i].values.take(pa.array(own))
                yield no.as_py(), *_spans(ids, np.concatenate([[0], np.cumsum(count)]), own), toxic[own], langs


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """The sums of tasks' numbers (block, sums) by block."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for x, wide in zip(b.column("sums"), b.column("wide"), strict=True):
                total = total + np.frombuffer(x.as_buffer(), np.int64 if wide.as_py() else np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    return {r["block"]: np.frombuffer(r["sums"], np.int64) for r in df.groupBy("block").applyInArrow(run, "block int, sums binary").collect()}


def _blocks(*tables: np.ndarray) -> pa.RecordBatch:
    """The numbers of some tables as rows (block, wide, sums); wide: as longs, as ints would not hold them."""
    flat = [x.ravel() for x in tables]
    wide = [bool(len(x) and np.abs(x).max() >= 1 << 31) for x in flat]
    data = [x.astype(np.int64 if w else np.int32).tobytes() for x, w in zip(flat, wide, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(wide), pa.array(data, pa.binary())], names=["block", "wide", "sums"])


_NUMBERS = "block int, wide boolean, sums binary"


def _seen(shards: DataFrame) -> np.ndarray:
    """(2, FEATURES): how many toxic and how many other training rows have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), np.int64)
        for _, ids, first, toxic, _ in _unpacked(batches, False):
            for some in _steps(np.arange(len(toxic)), np.diff(first), 1 << 12):
                mine, bounds = _spans(ids, first, some)
                doc = np.repeat(some, np.diff(bounds))
                for i in range(mine.shape[1]):
                    pairs = np.unique(doc * FEATURES + mine[:, i])
                    np.add.at(seen, (1 - toxic[pairs // FEATURES].astype(int), pairs % FEATURES), 1)
        if seen.any():
            yield _blocks(*seen)

    found = _summed(shards.mapInArrow(run, _NUMBERS))
    return np.stack([found.get(i, np.zeros(FEATURES, np.int64)) for i in range(2)])


def _round(shards: DataFrame, now: tuple[Model, dict], weights: tuple[float, float], passes: int, no: int, seed: int) -> tuple[Model, dict]:
    """The model after every shard has been passed over."""
    held = shards.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for shard, ids, first, toxic, _ in _unpacked(batches, False):
            own = pickle.loads(pickle.dumps(held.value))
            train(*own, ids, first, toxic, weights, passes, np.random.default_rng([seed, no, shard]))
            found = _changes(held.value, own)
            total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
        if total is not None:
            yield _blocks(*(total[0][i : i + BLOCK] for i in range(0, FEATURES, BLOCK)), total[1])

    found = _summed(shards.mapInArrow(run, _NUMBERS))
    held.unpersist()
    if not found:
        return now
    last = max(found)
    return _changed(now, np.concatenate([found[i] for i in range(last)]).reshape(FEATURES, -1), found[last])


def _lines(shards: DataFrame, model: Model) -> dict[str | None, float]:
    """The margins with the best F1 over all calibrating rows, in the middle of their gap: over all (None) and by
    language, where both classes have enough examples."""
    spark = shards.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, first, toxic, langs in _unpacked(batches, True):
            for some in _steps(np.arange(len(toxic)), np.diff(first), 1 << 12):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(some)), pa.array(held.value.margins(*_spans(ids, first, some))), pa.array(toxic[some].astype(np.int64))], names=["lang", "margin", "yes"])

    own = table(shards.mapInArrow(run, "lang string, margin double, yes long"), "margins")
    own = own.withColumn("lang", F.explode(F.array(F.lit(None).cast("string"), "lang")))
    both = own.groupBy("lang").agg(F.sum("yes").alias("toxic"), F.count("*").alias("all")).where(F.least("toxic", F.col("all") - F.col("toxic")) >= ENOUGH)
    each = own.groupBy("lang", "margin").agg((F.sum("yes") * (1 << 32) + F.count("*")).alias("both"))
    order = -F.col("margin")
    each = prefix(each.withColumn("order", order), ["lang"], F.floor(F.greatest(F.least("order", F.lit(60.0)), F.lit(-60.0)) * 32), ["order"], "before", F.col("both"))
    upto = F.col("before") + F.col("both")
    each = each.withColumns({"hits": F.shiftright(upto, 32), "rows": upto.bitwiseAND((1 << 32) - 1)}).join(both.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    best = each.groupBy("lang").agg(F.max(F.struct((2 * F.col("hits") / (F.col("rows") + F.col("toxic"))).alias("f1"), "margin")).alias("best"))
    best = table(best.select(F.col("lang").alias("of"), F.col("best.margin").alias("top")), "lines")
    under = own.join(best, F.col("lang").eqNullSafe(F.col("of")) & (F.col("margin") < F.col("top"))).groupBy("of").agg(F.max("margin").alias("next"))
    found = {r["of"]: r["top"] for r in best.collect()}
    found |= {r["of"]: (found[r["of"]] + r["next"]) / 2 for r in under.collect()}
    for x in (own, best):
        drop(x)
    held.unpersist()
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = ROWS, size: int = BYTES, seed: int = 3) -> Model:
    """A model of all labelled rows but those whose doc_id is held out or null. Whole texts count, whatever their
    length; null ones have no words. A doc_id with two labels counts as toxic; rows with one doc_id are examples of
    their own. sample, size: about so many rows and bytes of text are passed over by a task before models are averaged;
    no bound on what is learned from. Without examples all scores are alike."""
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    marks = marked(labels)
    found = docs.select("doc_id", length.alias("bytes")).join(marks, "doc_id")  # without the texts, which stay in place
    own = F.when(~_calibrates("doc_id"), F.col("toxic"))
    r = found.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.count(own).alias("own"), F.sum(own).alias("toxic")).first()
    if not r["rows"]:
        return start(np.zeros((2, FEATURES)), (0, 0), seed)[0]
    n, toxic = r["own"], r["toxic"] or 0
    count = max(1, -(-r["rows"] // sample), -(-r["bytes"] // size))
    ids = found.select("doc_id").distinct()
    shards = table(_shards(_likely(docs, ids, r["rows"]), marks, count), "shards")
    now = start(_seen(shards), (toxic, n - toxic), seed)
    weights = n / (2 * max(1, n - toxic)), n / (2 * max(1, toxic))
    epochs = min(EPOCHS[1], max(EPOCHS[0], PASSES // max(1, n)))
    for no in range(epochs if count > 1 else 1):
        now = _round(shards, now, weights, 1 if count > 1 else epochs, no, seed)
    model, lines = now[0], _lines(shards, now[0])
    drop(shards)
    usual = float(np.log(weights[1] / weights[0]))  # takes back the weights of classes too small for a line
    model.shift = -lines.pop(None, usual)  # the best line between the classes has score 0.5
    model.thresholds = {x: float(_logistic(line + model.shift)) for x, line in sorted(lines.items())}
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("score", "threshold", "flagged")) -> DataFrame:
    """All columns of docs, and three more by names: score (0 to 1), threshold (its language's, 0.5 for languages
    without enough examples) and flagged (score reaches the threshold). Columns of docs with these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    own, (value, line_name, flag) = docs.columns, names
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, size=CHUNK):
            s = m.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*own, value])

    out = docs.mapInArrow(run, ", ".join([*kinds, f"`{value}` double"]))
    lines = model.thresholds or {}
    line = F.lit(0.5)
    for lang, x in lines.items():
        line = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(x)).otherwise(line)
    return out.withColumn(line_name, line).withColumn(flag, F.col(value) >= F.col(line_name))


def op5_toxicity(spark, sf_dir):
    """The toxicity of all documents.

    Null and empty texts have no words and score as such; repeated doc_ids and rows are scored each; a null doc_id
    counts as held out; a null language has a threshold of its own. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")
