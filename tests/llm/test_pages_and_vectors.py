"""Page extraction, near vectors and neighbour search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from cascadia.llm import extraction, near_vectors, neighbours
from cascadia.llm.components import components
from cascadia.llm.fm_index import FMIndex

PAGE = """<!doctype html><html><head><title>Site | A page</title><style>p{}</style><script>var x = "</p>";</script></head>
<body class="with-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, to be clear. Accept them.</div>
<div id="content"><h1>A title &amp; more</h1><p><b>First paragraph, with words.<br>And a second line; it goes on.<p>Short.
<div class="ad">Buy this now, it is cheap.</div><form><label>Mail</label></form>
<blockquote>Quoted text, also part of it.</blockquote></div>
<div id="comments"><p>Nice post, I liked it. Really, very much.</p></div><aside>Aside text, not it.</aside>
<footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "A title & more\n\nFirst paragraph, with words. And a second line; it goes on.\n\nShort.\n\nQuoted text, also part of it."
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<nav>x</nav>") == ""
    assert extraction.main_text("<p title='a>b'>plain " + "text, more. " * 20_000 + "</p>").startswith("plain text, more.")


def test_extract_table(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4), (None, "v", "", 5)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["text"] == "" for r in got) == 2
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(500, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.03
    hot = base[:1] + rng.normal(size=(150, 16)) * 0.02
    x = np.vstack([base, near, hot, base[:20], np.repeat(base[7:8], 40, axis=0)]) * rng.uniform(0.5, 3, (770, 1))
    rows = [(i, v.tolist(), int(i % 2) if i < 560 else 0) for i, v in enumerate(x)]
    return rows + [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] * 16, 1), (905, x[0].tolist(), None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_near_vectors(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in near_vectors.near(table(spark, rows)).collect()}
    good = [r for r in rows if r[0] < 900]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    assert len(got) == len(rows)
    assert sum(got[i]["n_links"] for i in range(len(good))) >= 0.99 * hit.sum()
    assert all(got[i]["n_links"] <= hit[i].sum() for i in range(len(good)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))
    assert near_vectors.near(table(spark, [])).count() == 0


def linked(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of each row by comparing all pairs."""
    unit = [np.array(v, float) / np.linalg.norm(v) if v and label is not None and None not in v and 0 < np.linalg.norm(v) < np.inf else None for _, v, label in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    up = list(range(len(rows)))
    for _ in rows:
        for i, own in enumerate(links):
            up[i] = min([up[i], *(up[j] for j in own)])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[up[i]] = min(least.get(up[i], r[0]), r[0])
    return sorted(((r[0], len(own), least.get(u), r[0] == least.get(u)) for r, own, u in zip(rows, links, up, strict=True)), key=str)


def test_near_vectors_with_null_and_repeated_ids(spark):
    x = np.random.default_rng(9).normal(size=(6, 8)).tolist()
    bent = (np.array(x[0]) + 0.02 * np.array(x[1])).tolist()
    rows = [(7, x[0], 0), (3, bent, 0), (7, x[2], 0)]  # one id, in one label: a linked vector and one without links
    rows += [(7, x[3], 1), (5, x[3], 1), (7, x[4], 2)]  # the same id in other labels
    rows += [(None, x[0], 0), (None, x[1], 1), (None, x[1], 1), (None, x[5], 3), (11, x[5], 3), (None, None, 0), (None, x[5], None)]
    rows += [(20, x[0], 4), (20, x[0], 4)]
    extra = [(*r, "a", 1, 2) for r in rows]
    df = spark.createDataFrame(extra, "vec_id long, embedding array<double>, label int, key string, rep int, node int")
    assert sorted(map(tuple, near_vectors.near(df).collect()), key=str) == linked(rows)


def test_near_vectors_in_tiles_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(3, 8))
    rows = [(i, (base[i % 3] + rng.normal(size=8) * 0.12).tolist(), "ab"[i % 5 == 0]) for i in range(400)]
    monkeypatch.setattr(near_vectors, "BLOCK", 50)
    monkeypatch.setattr(near_vectors, "TILE", 16)
    got = sorted(map(tuple, near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()), key=str)
    want = linked(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert [g[0] for g in got if g[3]] == [w[0] for w in want if w[3]]


def test_near_vectors_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [], 0)]
    got = sorted(map(tuple, near_vectors.near(table(spark, rows)).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_neighbours_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(200)]
    rows += [(20, rng.normal(size=4).tolist(), 0), (None, [9.0] * 4, 0), (300, [1.0] * 5, 0), (301, None, 0), (20, rows[20][1], 0)]
    rows += [(400 + i, rows[40][1], 0) for i in range(30)]  # ties
    extra = spark.createDataFrame([(*r, "b", "c", 1.5) for r in rows], "vec_id long, embedding array<double>, label int, key string, vec string, score double")
    runs = [sorted(map(tuple, neighbours.search(extra, F.col("vec_id") % 20 == 0, 20, 0.9999999).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    vectors_of = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == 4:
            vectors_of.setdefault(i, []).append(np.array(v))
    first = {(r[0], r[2]): r[3] for r in runs[0]}
    assert {q for q, _ in first} == {i for i in vectors_of if i % 20 == 0}
    for q in sorted({q for q, _ in first} - {20}):
        options = [{i: max(float(x @ vectors_of[q][0]) for x in (own if i != 20 else [v])) for i, own in vectors_of.items() if i != q} for v in vectors_of[20]]
        best = [[(i, s) for i, s in sorted(o.items(), key=lambda x: (-x[1], x[0]))[:20]] for o in options]
        got = [(r[2], r[3]) for r in runs[0] if r[0] == q]
        assert any([i for i, _ in b] == [i for i, _ in got] and np.allclose([s for _, s in b], [s for _, s in got]) for b in best)


def test_neighbours_in_blocks(spark, monkeypatch):
    rows = vectors(2)
    whole = sorted(map(tuple, neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PROBES", 7)
    monkeypatch.setattr(neighbours, "GATHER", 50)
    assert sorted(map(tuple, neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())) == whole


def test_neighbours(spark):
    rows = vectors(1)
    got = neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    x = np.array([r[1] for r in rows if r[0] < 900])
    found = hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        hits += len(best & {r["vec_id"] for r in own})
        found += 20
    assert hits >= 0.9 * found
    few = [(i, [float(i + 1), 1.0], 0) for i in range(0, 60, 10)]
    assert neighbours.search(table(spark, few), F.col("vec_id") % 20 == 0, 20).count() == 15
    assert neighbours.search(table(spark, []), F.lit(True)).count() == 0


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 1), (20, 21), (22, 21), (7, 7), (None, 2)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {5: 1, 3: 1, 9: 1, 1: 1, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 161)}


def test_fm_index():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 4, rng.integers(5, 40)) for _ in range(30)]
    text = np.concatenate([np.r_[p, 0] for p in pieces])
    length = np.array([len(p) for p in pieces])
    start = np.cumsum(length + 1) - length - 1
    index = FMIndex(text, 4, 5, np.arange(len(text)), keep=True)
    place, row = index.matches(start, length, text)
    assert sorted(place.tolist()) == sorted(s + i for s, n in zip(start, length, strict=True) for i in range(n - 4))
    for p, r in zip(place, row, strict=True):
        assert (text[index.suffixes[r] :][:5] == text[p : p + 5]).all()
        first = next(i for i in range(len(text)) if (text[i : i + 5] == text[p : p + 5]).all() and len(text) >= i + 5)
        assert index.least[index.group(np.array([r]))[0]] == first
