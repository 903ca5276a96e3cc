"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cascadia.llm import licenses, mixing, packing, set_join, sharding, stages, substrings, toxicity

RX = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Ünï"] * 30
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    texts += texts[:8]  # copies
    for t in texts[:10]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [f"{t} {passage} {t}" for t in texts[20:30]]
    texts += [None, "", "  \t\n", "one", "two words", "x " * 3000, "a b c d e f g h i j k l m", "y" * 50_000]
    return list(enumerate(texts))


def test_substrings_against_brute_force(make):
    rows = corpus()
    got = {r["doc_id"]: r for r in substrings.remove(make(rows)).collect()}
    first = {}
    for d, t in rows:
        w = RX.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), d) < d:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substrings.remove(make([])).count() == 0


def test_substrings_null_and_repeated_ids(make):
    text = " ".join(f"t{i}" for i in range(20))
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in substrings.remove(make([(1, text), (1, text), (None, text)])).collect())
    assert got == [(False, 0), (False, 0), (True, 20)]


def shingle_set(t):
    w = RX.findall((t or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def test_set_join_against_brute_force(make):
    rows = corpus(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.join(make(rows), 3, 90).collect()}
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                x = len(sets[a] & sets[b])
                if x and 100 * x >= 90 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    assert got == {d: (len(sets[d]), up[d]) for d, _ in rows}
    assert set_join.join(make([])).count() == 0


def test_set_join_finds_texts_by_a_join_beyond_the_filter(make, monkeypatch):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(5, long), (6, long + " end"), (6, "a b c d"), (None, long + " other end"), (None, "e f g"), (7, long[: len(long) // 2])]
    results = []
    for marks in (set_join.MARKS, 0):
        monkeypatch.setattr(set_join, "MARKS", marks)
        results.append(sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.join(make(rows), 3, 90).collect()), key=str))
    assert results[0] == results[1]
    assert {(d, c) for d, n, c in results[0] if n > 2000} == {(5, 5), (6, 5), (None, 5)}
    assert len(results[0]) == len(rows)


def test_parity_maps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n, m, shared in ((10, 12, 5), (3000, 2900, 2850), (40_000, 700, 600), (5000, 5000, 5000), (2000, 2000, 0)):
        both = np.unique(rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64))
        x, y = both[:n], both[n - shared :]
        a, b = set_join.parity(x), set_join.parity(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(set_join.folded(a, size) ^ set_join.folded(b, size)).sum())
        assert (len(x) + len(y) - differ) // 2 >= len(np.intersect1d(x, y))


def test_packing(make):
    rows = corpus(3)
    got = packing.pack(make(rows)).collect()
    coder = packing.Encoder(packing.default_tokenizer())
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        n = len(coder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == n and all(r["length"] == 1024 for r in own[1:])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.pack(make([])).count() == 0


def pieces_of(coder, text, limit=1024):
    """(piece, start, length, crc32) of a text's pieces, from the tokenizer itself."""
    ids = [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    cuts = list(range(len(ids), 0, -limit))[::-1]
    return [(i, max(0, e - limit), e - max(0, e - limit), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[max(0, e - limit) : e]))) for i, e in enumerate(cuts)]


def test_packing_ids_against_the_tokenizer(make):
    rows = [*corpus(13), (None, "no id"), (None, "no id"), (4, "again"), (4, "again"), (4, "日本語 text"), (None, None)]
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(make(rows)).collect())
    coder = packing.Encoder(packing.default_tokenizer())
    assert got == Counter((d, *x) for d, t in rows for x in pieces_of(coder, t))


def test_encoder_of_another_file():
    import public_tokenizers

    coder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("Hello there,  you\n\n 123 times", "", "don't", "x  y"):
        assert coder.encode(t, True) == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_is_the_tokenizer():
    rng = random.Random(5)
    coder = packing.Encoder(packing.default_tokenizer())
    letters = [chr(i) for i in range(0x260)] + [" ", "\n", "'s", "日", "<|endoftext|>"] * 20
    texts = ["".join(rng.choice(letters) for _ in range(50)) for _ in range(300)]
    for t, easy in zip(texts, packing.plain(pa.array(texts)), strict=True):
        assert coder.encode(t, easy) == coder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [16, 100])
def test_plan_uses_every_piece_once(limit):
    counts = np.random.default_rng(limit).integers(0, 50, limit + 1)
    counts[0] = 0
    used = Counter()
    for lengths, times in packing.plan(counts, limit):
        assert sum(lengths) <= limit and times > 0
        for n in lengths:
            used[n] += times
    assert all(used[n] == counts[n] for n in range(limit + 1))


def test_sharding(make):
    rows = corpus(4) + [(1000 + i, "hot text") for i in range(90)] + [(None, "null id"), (5, "again"), (5, "again")]
    got = sharding.shard(make(rows), 8).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    small = {}
    for r in got:
        small.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    hot = max(small.values(), key=len)
    assert sum(len(s) > 1 for s in small.values() if s is not hot) <= 1 and len(hot) <= 5
    assert sharding.shard(make([]), 8).count() == 0


def test_sharding_sizes_and_hashes(make):
    rows = [*corpus(14), *((2000 + i, "hot text") for i in range(5000)), (None, "日本"), (None, None), (7, "x"), (7, "x")]
    got = sharding.shard(make(rows), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1


def test_quotas_keep_sizes():
    asked, free = [[0, 5, 0], [2, 0, 0], [9, 0, 0]], [3, 0, 4]
    moves = sharding.quotas(asked, free)
    for b in range(3):
        assert sum(moves[a][b] for a in range(3)) - sum(moves[b]) <= free[b]


def test_mixing(make):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice("abcde")) for i in range(200)] + [(900, "tiny one", None), (901, None, "z"), (902, "x " * 5000, "a")]
    docs, slots = mixing.mix(make(rows))
    got = docs.collect()
    total = sum(r["size"] for r in got)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) < 1 and target[s] <= 3 * size[s] + 1e-9 for s in taken)
    assert sorted(map(tuple, mixing.mix(make(rows))[0].collect()), key=repr) == sorted(map(tuple, got), key=repr)
    # any stretch of the schedule is near the shares
    order = [(r["s"], r["words"]) for r in slots.orderBy("j").collect()]
    half = Counter()
    for s, w in order[: len(order) // 2]:
        half[s] += w
    whole = Counter()
    for s, w in order:
        whole[s] += w
    assert all(abs(half[s] / sum(half.values()) - whole[s] / sum(whole.values())) < 0.1 for s in whole)
    assert mixing.mix(make([]))[0].count() == 0


def test_licenses(make):
    rng = random.Random(7)
    filler = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    long = licenses.TEMPLATES["mit"][1]
    changed = long.replace("merge,", "combine,")
    rows = [(0, filler(300)), (1, f"{filler(77)} Licensed under CC BY-NC 4.0. {filler(30)}"), (2, f"{filler(5)}\n{long}\n{filler(500)}"), (3, changed), (4, None), (5, ""), (6, "Released under the MIT License."), (7, f"{filler(2000)} {licenses.TEMPLATES['bsd'][0]}")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(make(rows)).collect())
    assert got == [(1, "cc-by-nc-4.0"), (2, "mit"), (3, "mit"), (6, "mit"), (7, "bsd")]
    assert licenses.scan(make([])).count() == 0


def test_licenses_in_odd_rows(make):
    rows = [(1, None), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (3, ""), (3, "Released under the MIT License."), (5, "pad " * 200_000 + "Released under the MIT License." + " pad" * 1000), (6, "z" * 300_000)]
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(make(rows)).collect())
    assert got == {(None, "mit"): 2, (3, "mit"): 1, (5, "mit"): 1}


def test_toxicity_of_odd_rows(make, spark):
    rng = random.Random(15)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(30)), *(["vile"] if i % 2 else [])])) for i in range(300)]
    docs = make([*rows, *rows[:20], *((11, "repeated " * 5) for _ in range(50)), (12, "word1 " * 60_000), (None, "vile"), (900, "word1 " * 50_000 + "vile")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (12, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=100, size=40_000)
    got = toxicity.score(docs.withColumn("score", F.lit("kept?")).withColumn("threshold", F.lit(7.5)), model, ("score", "line", "bad"))
    assert got.columns == [*docs.columns, "threshold", "score", "line", "bad"] and got.where("threshold <> 7.5").count() == 0
    rows = got.collect()
    assert len(rows) == 300 + 20 + 50 + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["bad"] == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and r["text"].startswith("word")) >= 280


def test_toxicity_on_held_out_rows(make, spark):
    rng = random.Random(8)
    clean = [f"word{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.randrange(10, 80))]
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = "nasty" + rng.choice("abcdefgh") * 2
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs = make([*rows, (700, None), (701, ""), (None, "word1 word2")])
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(600) if got[i]["held"]]
    assert sum((got[i]["score"] >= 0.5) == bool(marks[i][1]) for i in held) >= 0.95 * len(held)
    assert 0 <= got[700]["score"] < 0.5 and got[700]["score"] == got[701]["score"]
    none = toxicity.fit(make([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(make([]), none).count() == 0


def test_toxicity_learns_from_all_labelled_rows(make, spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(2400):  # each of the 120 marks of toxic rows is in some ten of them, too few in any hundred rows
        w = [f"word{rng.randrange(300)}" for _ in range(25)]
        if i % 2:
            w[rng.randrange(25)] = f"{i // 2 % 120}mark"
        rows.append((i, " ".join(w)))
        marks.append((i, i % 2))
    for i in range(2400, 2440):  # one word that only long texts have
        rows.append((i, "word1 " * 30_000 + ("endmost" if i % 2 else "ending")))
        marks.append((i, i % 2))
    docs, labels = make(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    want = {i for i in range(2440) if zlib.crc32(str(i).encode()) % 5}
    marks = toxicity.marked(labels)
    assert {r["doc_id"] for r in marks.collect()} == want
    likely = toxicity._likely(docs, marks, len(want)).cache()
    assert want <= {r["doc_id"] for r in likely.collect()}
    packed = toxicity._shards(likely, marks, 9).toArrow().to_batches()
    parts = [x for calibrates in (False, True) for x in toxicity._unpacked(packed, calibrates)]
    assert sum(len(x[3]) for x in parts) == len(want) and sum(x[3].sum() for x in parts) == sum(i % 2 for i in want)
    assert sum(len(x[1]) for x in parts) == sum(len(rows[i][1].split()) for i in want)
    model = toxicity.fit(docs, labels, sample=100)
    new = [(-1 - k, f"word5 word6 {k}mark word7") for k in range(120)] + [(-200, "word5 endmost")] + [(-300 - k, f"word5 word6 word{k} word7") for k in range(120)]
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(make(new), model).collect()}
    assert sum(got[-1 - k] for k in range(120)) >= 110 and got[-200] and sum(got[-300 - k] for k in range(120)) <= 10
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), sample=100)
    assert all(np.array_equal(x, y) for x, y in zip([model.words, model.out, *model.filters, *model.bias], [again.words, again.out, *again.filters, *again.bias], strict=True))


def test_toxicity_lines_come_from_all_calibrating_rows(make, spark):
    model = toxicity.start(np.zeros((2, toxicity.FEATURES)), (0, 0))[0]
    rows = [(i, f"word{i * 37 % 500} other{i * 11 % 90}") for i in range(700)]
    labels = spark.createDataFrame([(i, int(i * 37 % 500 < 100)) for i in range(700)], "doc_id long, toxic int")
    docs, marks = make(rows), toxicity.marked(labels)
    line = toxicity._lines(toxicity._shards(docs, marks, 6), model)
    found = docs.join(marks, "doc_id").where(toxicity._calibrates("doc_id")).collect()
    own = sorted(((float(model.margins(*toxicity.features(pa.array([r["text"]])))[0]), r["toxic"]) for r in found), reverse=True)
    total, best = sum(y for _, y in own), (-1, 0)
    for i, (x, _) in enumerate(own):
        if i + 1 == len(own) or own[i + 1][0] < x:
            best = max(best, (2 * sum(y for _, y in own[: i + 1]) / (i + 1 + total), x))
    under = [x for x, _ in own if x < best[1]]
    assert set(line) == {None, "en"} and line[None] == line["en"]
    assert abs(line[None] - ((best[1] + under[0]) / 2 if under else best[1])) < 1e-6



def test_stages_keep_columns(make, spark, tmp_path):
    rows = corpus(9)
    docs = make(rows)
    kept = stages.one_of_each(spark, docs, "", 3, 90)
    assert kept.columns == docs.columns
    table = set_join.join(docs, 3, 90).where("n_shingles = 0 or doc_id = component_id").count()
    assert kept.count() == table
    cleared = stages.without_repeats(spark, docs, "")
    assert cleared.columns == docs.columns and cleared.where("doc_id = 60").count() == (1 if substrings.remove(docs).where("doc_id = 60 and n_removed < n_words").count() else 0)
    out = stages.mixed(spark, docs, "")
    assert out.columns == docs.columns
    want = sum(r["taken"] for r in mixing.mix(docs)[0].collect())
    assert sum(len(RX.findall(r["text"])) for r in out.collect()) == want
