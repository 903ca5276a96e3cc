"""Pipeline stages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cascadia.llm import mixing, packing, stages, toxicity

RX = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    w = RX.findall((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def smallest_linked(rows, k, percent):
    """Of each row the place of the first row that links lead to."""
    sets, up = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                x = len(sets[a] & sets[b])
                if x and 100 * x >= percent * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    return up


def test_near_copies_by_five_words_and_four_fifths(make, spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = [words(500) for _ in range(4)]
    edited = base[1][:]
    for i in range(25, 500, 50):
        edited[i] = "changed"
    below = base[2][:]
    for i in range(10, 500, 25):
        below[i] = "changed"
    rows = [(i, " ".join(w)) for i, w in enumerate([*base, base[0] + words(90), edited, below, words(300)])]
    up = smallest_linked(rows, 5, 80)
    assert up[4:] == [0, 1, 6, 7]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    got = sorted(r["doc_id"] for r in stage(spark, make(rows), "").collect())
    assert got == sorted({rows[u][0] for u in up})


def test_one_of_each_with_repeated_and_null_ids(make, spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(3, b), (5, a), (5, b), (6, c), (6, c + " end"), (None, d), (None, d), (None, d + " end"), (None, e), (9, e + " end")]
    rows += [(7, ""), (7, ""), (None, None), (None, None), (8, " ")]
    got = [(r["doc_id"], r["text"]) for r in stages.one_of_each(spark, make(rows), "").collect()]
    assert [x for x in got if x[1] and x[1].startswith((a, b))] in ([(3, b), (5, a)], [(5, a), (3, b)])
    assert [x[0] for x in got if x[1] and x[1].startswith(c)] == [6]
    assert [x[0] for x in got if x[1] and x[1].startswith(d)] == [None]
    assert [x for x in got if x[1] and x[1].startswith(e)] == [(9, e + " end")]
    assert sorted((x for x in got if not (x[1] or "").strip()), key=str) == sorted([(7, ""), (None, None), (None, None), (8, " ")], key=str)


def test_mixed_takes_each_row_by_itself(make, spark):
    rows = [(None, f"{c} " * 20 + c, "a") for c in "pqrstuvw"] + [(None, "same text", "a")] * 3 + [(i, "word " * 9, "bc"[i % 2]) for i in range(40)]
    docs = make(rows)
    out = [r["text"].split() for r in stages.mixed(spark, docs, "").collect()]
    want, got = Counter(), Counter()
    for r in mixing.mix(docs)[0].collect():
        want[r["source"]] += r["taken"]
    for r in stages.mixed(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    assert got == want
    assert sum(map(len, out)) == sum(want.values())
    # the mix takes each text of a source in full rounds, but for one
    rounds = {c: sum(w == [c] * 21 for w in out) for c in "pqrstuvw"}
    assert max(rounds.values()) - min(rounds.values()) <= 1


def test_stages_leave_columns_of_any_name(make, spark, tmp_path):
    names = ["score", "threshold", "flagged", "_id", "_text", "_spans", "_one", "_words", "a.b", "s", "at", "turn", "Size"]
    rows = [(i, f"t{i} " * 5 + f"u{i}", "ab"[i % 2]) for i in range(20)] + [(None, None), (3, ""), (3, "")]
    docs = make(rows)
    for n, name in enumerate(names):
        docs = docs.withColumn(f"extra{n}", F.lit(f"v{n}"))
    docs = docs.drop("size").toDF("doc_id", "text", "lang", "source", "n_chars", *names)
    spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(f"v{n}" for n in range(len(names))) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def mixed_words(rows):
    """The texts that the mix takes of rows (doc_id, text, source), with repeats, one list of words for each copy."""
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(RX.findall(t or "")) for _, t, x in rows if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total, target, left = sum(sizes.values()), {}, set(sources)
    while True:
        rest = total - sum(target.values())
        share = rest / max(1, sum(weight[s] for s in left))
        over = {s for s in left if share * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in left}
            break
        target |= {s: float(3 * sizes[s]) for s in over}
        left -= over
    found = []
    for s in sources:
        take = int(target[s] + 1e-6)
        own = sorted((int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:8], 16), d, len(RX.findall(t or "")), t) for d, t, x in rows if x == s and RX.findall(t or ""))
        while take > 0:
            for _, d, n, t in own:
                if take >= n:
                    found.append((d, t))
                elif take > 0:
                    found.append((d, " ".join(RX.findall(t)[:take])))
                take -= min(take, n)
    return found


def test_run_against_plain_python(make, spark, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(20, 90)), "abc"[i % 3]) for i in range(160)]
    for i in range(100, 160):  # every second of these is toxic
        rows[i] = (i, rows[i][1] + (" vilest" if i % 2 else " kindest"), rows[i][2])
    rows += [(200, rows[3][1], "b"), (201, rows[4][1] + " end", "c")]
    passage = text(40)
    rows += [(210 + i, f"{text(30)} {passage} {text(30)}", "a") for i in range(3)]
    rows += [(220, "", "a"), (221, None, None), (222, "two words", "b"), (223, text(3000), "c")]
    make(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 100 and i % 2 == 1)) for i in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(make(rows), spark.read.parquet(str(tmp_path / "labels.parquet")))
    bad = {r["doc_id"] for r in toxicity.score(make(rows), model).where("flagged").collect()}
    assert len(bad & {i for i in range(100, 160) if i % 2}) >= 25 and len(bad) <= 35
    rows = [r for r in rows if r[0] not in bad]
    up = smallest_linked([r[:2] for r in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if up[i] == i]
    first, left = {}, []
    for d, t, s in sorted(rows, key=lambda r: r[0]):
        w = RX.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), d) < d:
                gone[p : p + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        if not any(gone) or kept:
            left.append((d, " ".join(kept) if any(gone) else t, s))
    coder = packing.Encoder(packing.default_tokenizer())
    want = Counter()
    for d, t in mixed_words(left):
        ids = [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids), 0, -1024))[::-1]
        want.update((d, i, e - max(0, e - 1024), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[max(0, e - 1024) : e]))) for i, e in enumerate(cuts))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
    room = Counter()
    for r in got:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 1024 and len(room) <= -(-sum(room.values()) // 1024) + 1
