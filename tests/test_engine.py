"""Graph sources, hash, micro graphs, estimators, greedy choice and the command line on small examples."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cascadia import cli
from cascadia.functions.hashing import hashed, murmur
from cascadia.operators import greedy, influence, ranks, sampling, sketch
from cascadia.operators.graph import Graph
from cascadia.operators.live import live_edges
from cascadia.operators import reach as searches
from cascadia.operators.reach import firsts, pack, reach, sizes, spread
from cascadia.sources import binary, text

# fixed values: u, v, i, l, seed and the hash
GOLDEN = [
    (0, 0, 0, 64, 31101982, 1589589334), (0, 1, 0, 64, 31101982, 3168590118), (1, 0, 0, 64, 31101982, 668175369),
    (0, 1, 1, 64, 31101982, 2839607497), (0, 1, 0, 32, 31101982, 4088839389), (0, 1, 0, 64, 31167518, 3168590118),
    (1999, 7, 63, 64, 31101982, 4089878255), (12345, 67890, 15, 16, 1, 3244611348), (1073741823, 0, 0, 64, 0, 3123179571),
]


def graph(spark, arcs, n=None, **options):
    return Graph.from_arcs(spark.createDataFrame(arcs, "a long, b long"), n=n, **options)


@pytest.mark.parametrize("u,v,i,l,seed,h", GOLDEN)
def test_hash(spark, u, v, i, l, seed, h):  # noqa: E741
    assert murmur(u, v, i, l, seed) == h
    assert hashed(spark.createDataFrame([(u, v, i)], "u long, v long, i int"), "u", "v", "i", l, seed).first()["h"] == h


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_influence_of_micro_graphs(spark, p):
    for arcs, sets in (([(0, 1), (1, 2), (2, 3)], {(0,): 4, (2,): 2, (0, 2): 4, (1, 1): 3}), ([(0, 1), (0, 2), (0, 3)], {(0,): 4, (1, 2): 2}), ([(0, 1), (1, 2), (2, 0)], {(1,): 3})):
        live = live_edges(graph(spark, arcs), "binary", 3, p=p)
        seeds = spark.createDataFrame([(q, v) for q, s in enumerate(sets) for v in s], "q long, v long")
        got = {r["q"]: r["exact"] for r in influence.exact(live, seeds, 3).collect()}
        assert got == {q: (want if p else len(set(s))) for q, (s, want) in enumerate(sets.items())}


def test_undirected_and_parallel(spark):
    g = graph(spark, [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)], directed=False)
    assert {r["dst"]: r["indeg"] for r in g.in_degrees().collect()} == {0: 2, 1: 2, 2: 2}
    assert graph(spark, [(0, 1), (0, 1)]).in_degrees().first()["indeg"] == 2
    assert graph(spark, [(2, 1), (1, 0)], symmetrize=True).arcs.count() == 4
    with pytest.raises(ValueError):
        live_edges(g, "other")
    with pytest.raises(ValueError):
        graph(spark, [(0, 9)], n=3).validated()


def test_strategies_agree(spark):
    rng = random.Random(2)
    g = graph(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(120)], n=40)
    live = live_edges(g, "weighted", 4).cache()
    starts = spark.range(0, 40, 7).select(F.col("id").alias("q"), F.col("id").alias("v"))
    order = ranks.full(spark, 40, 4).cache()
    for make in (lambda s: reach(live, starts, 4, strategy=s), lambda s: sketch.per_instance(live, order, 5, s)):
        a, b = (sorted(map(tuple, make(s).collect())) for s in ("rounds", "worlds"))
        assert a == b and a
    assert ranks.is_permutation(order.withColumnRenamed("rank", "value"), 160)


@pytest.fixture
def many(spark, monkeypatch):
    """A live instance of 40,000 arcs, twice; rounds would write tables, which raises here."""

    def refuse(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(searches, "settle", refuse)
    monkeypatch.setattr(sketch, "settle", refuse)
    arcs = spark.range(40_000).select((2 * F.col("id")).alias("src"), (2 * F.col("id") + 1).alias("dst"))
    g = Graph.from_arcs(arcs)
    return g, live_edges(g, "binary", 2, p=1.0)


def test_counts_agree_with_pairs(spark):
    rng = random.Random(3)
    live = live_edges(graph(spark, [(rng.randrange(50), rng.randrange(50)) for _ in range(140)], n=50), "weighted", 3).cache()
    sets = spark.range(50).select(F.floor(F.col("id") / 3).alias("q"), F.col("id").alias("v"))
    found = list(map(tuple, reach(live, sets, 3, strategy="rounds").collect()))
    want, first, least = {}, {}, {}
    for q, i, v in found:
        want[q, i] = want.get((q, i), 0) + 1
        least[i, v] = min(q, least.get((i, v), q))
    for (i, _), q in least.items():
        first[q, i] = first.get((q, i), 0) + 1
    for strategy in ("rounds", "worlds"):
        assert {(r["q"], r["i"]): r["size"] for r in sizes(live, sets, 3, strategy=strategy).collect()} == want
        assert {(r["q"], r["i"]): r["size"] for r in firsts(live, sets, 3, strategy).collect() if r["size"]} == first


def test_many_queries_are_counted_where_they_are_found(many):
    g, live = many
    got = influence.exact(live, g.vertices().select(F.col("v").alias("q"), "v"), 2)
    assert {(r["exact"], r["n"]) for r in got.groupBy("exact").agg(F.count("*").alias("n")).collect()} == {(1.0, 40_000), (2.0, 40_000)}


def test_many_marginals_pass_each_vertex_once(many):
    g, live = many
    got = influence.marginals(live, g.vertices().select((F.col("v") + 1).cast("int").alias("step"), "v"), 2)
    assert {(r["marginal"], r["n"]) for r in got.groupBy("marginal").agg(F.count("*").alias("n")).collect()} == {(0.0, 40_000), (2.0, 40_000)}


def test_many_queries_reach_without_rounds(many):
    g, live = many
    own = g.vertices().select(F.col("v").alias("q"), "v")
    assert reach(live, own, 2).count() == 240_000
    assert reach(live.select("i", F.col("dst").alias("src"), F.col("src").alias("dst")), own, 2).count() == 240_000


def test_large_sketches_need_no_rounds(spark, many):
    g, live = many
    got = sketch.lists(live, ranks.full(spark, g.n, 2), 256)
    assert sketch.combined(got, 256).count() == 240_000
    assert sketch.combined(got, 3).groupBy("u").count().groupBy("count").count().count() == 2  # 2 of a head, 3 of a tail's 4


def test_lists_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(sketch, "STEP", 8)
    monkeypatch.setattr(sketch, "HELD", 16)
    rng = random.Random(4)
    live = live_edges(graph(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(120)], n=40), "weighted", 3).cache()
    order = ranks.full(spark, 40, 3).cache()
    want = sketch.combined(sketch.per_instance(live, order, 5, "rounds"), 5).collect()
    assert sorted(map(tuple, sketch.combined(sketch.lists(live, order, 5), 5).collect())) == sorted(map(tuple, want))


def test_sketches_of_some_vertices(spark):
    rng = random.Random(6)
    live = live_edges(graph(spark, [(rng.randrange(50), rng.randrange(50)) for _ in range(150)], n=50), "binary", 3, 5, 0.5).cache()
    order = ranks.full(spark, 50, 3).cache()
    some = spark.createDataFrame([(v,) for v in (3, 7, 7, 20, 49)], "v long")
    want = sorted(tuple(r) for r in sketch.combined(sketch.lists(live, order, 5), 5).collect() if r["u"] in (3, 7, 20, 49))
    for strategy in ("worlds", "rounds", "auto"):
        assert sorted(map(tuple, sketch.of(live, order, some, 5, 3, strategy).collect())) == want


def test_union_estimator(spark):
    sk = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate([1, 4, 9])] + [(1, i + 1, r) for i, r in enumerate([4, 12])], "u long, pos int, rank long")
    both = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "q long, v long")
    assert sketch.estimate(sk, both, 10, 3, 2).first()["estimate"] == pytest.approx(10 * (1 / 9 + 1 / 20 + 1 / 20))
    assert {r["u"]: r["estimate"] for r in sketch.estimate_all(sk, 10, 3, 2).collect()} == {0: pytest.approx(2 * 10 / 9), 1: 1.0}


def test_full_sketches_are_exact(spark):
    rng = random.Random(4)
    g = graph(spark, [(rng.randrange(20), rng.randrange(20)) for _ in range(50)], n=20)
    index = sketch.build(g, "binary", 1000, 3, 5, 0.4).cache()
    seeds = spark.createDataFrame([(0, 3), (0, 7), (1, 11)], "q long, v long")
    a = {r["q"]: r["estimate"] for r in sketch.estimate(index, seeds, 20, 1000, 3).collect()}
    b = {r["q"]: r["exact"] for r in influence.exact(live_edges(g, "binary", 3, 5, 0.4), seeds, 3).collect()}
    assert a == pytest.approx(b)


def test_greedy_example(spark):
    order = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (0, 0, 2), (3, 0, 3)], "v long, i int, rank long")
    got = greedy.maximize(graph(spark, [(0, 1), (0, 2), (0, 3)]), "binary", 3, 2, 1, p=1.0, ranks=order).collect()
    assert [(r["v"], r["est"], r["exact"]) for r in got] == [(0, 2.0, 4.0)]


def test_greedy_covers_all(spark):
    rng = random.Random(6)
    g = graph(spark, [(rng.randrange(15), rng.randrange(15)) for _ in range(30)], n=15)
    got = greedy.maximize(g, "weighted", 0, 4, 2).collect()
    assert sum(r["exact"] for r in got) == 15 and got[-1]["cum_exact"] == 15
    late = [r["exact"] for r in got if r["saturated"]]
    assert late == sorted(late, reverse=True)


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.metis").write_text("% a path\n4 3\n2\r\n% between\n3  3\n4\n\n")
    g = text.metis(spark, str(tmp_path / "g.metis"))
    assert g.n == 4 and sorted(map(tuple, g.arcs.collect())) == [(0, 1), (1, 2), (1, 2), (2, 3)]
    (tmp_path / "w.metis").write_text("2 1 1\n2 5\n1 5\n")
    with pytest.raises(ValueError):
        text.metis(spark, str(tmp_path / "w.metis"))
    (tmp_path / "g.gr.txt").write_text("c path\np sp 4 3\na 1 2 1\na 2  3 1\na 3 4\n")
    d = text.dimacs(spark, str(tmp_path / "g.gr.txt"), transpose=True)
    assert sorted(map(tuple, d.arcs.collect())) == [(1, 0), (2, 1), (3, 2)]
    text.write_metis(g, str(tmp_path / "out.metis"))
    text.write_dimacs(g, str(tmp_path / "out.dimacs"))
    assert sorted(map(tuple, text.dimacs(spark, str(tmp_path / "out.dimacs")).arcs.collect())) == sorted(map(tuple, g.arcs.collect()))


def test_metis_folders(spark, tmp_path):
    rng = random.Random(3)
    g = graph(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(900)], n=400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_metis(g, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.name.startswith("part-") and x.stat().st_size > 0 for x in (tmp_path / "parts").iterdir()) > 1
    back = text.metis(spark, str(tmp_path / "parts"))
    assert back.n == 400 and sorted(map(tuple, back.arcs.collect())) == sorted(map(tuple, g.arcs.collect()))


def test_smallest_graphs(spark):
    assert graph(spark, [(0, 0)], self_loops=True).n == 1
    assert graph(spark, [(0, 0)]).n == 0
    assert greedy.maximize(graph(spark, [(0, 0)], self_loops=True), "binary", 1, 2, 2).first()["exact"] == 1.0


def test_binary_records(spark, tmp_path):
    """Tags of one byte; data of vertices and arcs between and after the arcs."""
    head = struct.pack("<IB3xQQQQQ", 0x12341234, 1, 4, 5, 0, 2, 3)
    arc = lambda u, v, x: b"\x02" + struct.pack("<II", u, v) + x
    body = b"\x00ab" + arc(0, 1, b"xyz") + arc(1, 2, b"\x00\x02\x02") + b"\x00cd\x00\x02\x02" + b"".join(arc(3, v, b"...") for v in range(3)) + b"\x00gh"
    (tmp_path / "m.gr").write_bytes(head + body)
    g = binary.read(spark, str(tmp_path / "m"))
    assert g.n == 4 and sorted(map(tuple, g.arcs.collect())) == [(0, 1), (1, 2), (3, 0), (3, 1), (3, 2)]
    assert sorted(map(tuple, binary.vertex_data(spark, str(tmp_path / "m")).collect())) == [(0, b"ab"), (1, b"cd"), (2, b"\x02\x02"), (3, b"gh")]
    assert {bytes(r["data"]) for r in binary.arc_data(spark, str(tmp_path / "m")).collect()} == {b"xyz", b"\x00\x02\x02", b"..."}
    for bad in (b"\x01ab", b"\x02\x00"):
        with pytest.raises(ValueError):
            binary.decode(head + body + bad)


def test_binary_folders(spark, tmp_path):
    rng = random.Random(5)
    g = graph(spark, [(rng.randrange(3000), rng.randrange(3000)) for _ in range(5000)], n=3000)
    binary.write(g, str(tmp_path / "g"), 5)
    back = binary.read(spark, str(tmp_path / "g"))
    assert back.n == 3000 and sorted(map(tuple, back.arcs.collect())) == sorted(map(tuple, g.arcs.collect()))
    one = sorted(x for x in (tmp_path / "g.gr").iterdir() if x.suffix == ".txt" and x.stat().st_size)[0].read_bytes()
    n, _, tails, _ = binary.decode(one)
    assert n == 3000 and len(tails) == struct.unpack_from("<IB3xQQ", one)[3]
    none = graph(spark, [(0, 0)], n=7)
    binary.write(none, str(tmp_path / "none"))
    assert binary.read(spark, str(tmp_path / "none")).n == 7
    both = graph(spark, [(0, 1), (1, 0), (1, 2), (2, 1)], directed=False)
    binary.write(both, str(tmp_path / "both"))
    assert sorted(map(tuple, binary.read(spark, str(tmp_path / "both"), symmetrize=True).arcs.collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_one_vertex_spreads_as_searched(spark):
    rng = random.Random(8)
    live = live_edges(graph(spark, [(rng.randrange(60), rng.randrange(60)) for _ in range(150)], n=60), "weighted", 6).cache()
    for u in (0, 7, 59):
        want = reach(live, spark.createDataFrame([(0, u)], "q long, v long"), 6, strategy="rounds").select("i", "v")
        assert sorted(map(tuple, spread(pack(live), u, 6).collect())) == sorted(map(tuple, want.collect()))


def test_greedy_against_brute_force(spark):
    rng = random.Random(10)
    n, l, k = 25, 3, 4
    g = graph(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], n=n)
    order = list(range(n * l))
    rng.shuffle(order)
    rank = {(v, i): order[v * l + i] for v in range(n) for i in range(l)}
    out = {}
    for r in live_edges(g, "weighted", l).collect():
        out.setdefault((r["i"], r["src"]), []).append(r["dst"])

    def reached(u, i):
        seen, todo = {u}, [u]
        while todo:
            for w in out.get((i, todo.pop()), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    covered, want = set(), []
    while len(covered) < n * l:
        own = {u: sorted(rank[p] for i in range(l) for v in reached(u, i) if (p := (v, i)) not in covered) for u in range(n)}
        full = [(x[k - 1], u) for u, x in own.items() if len(x) >= k]
        u = min(full)[1] if full else max(own, key=lambda u: (len(own[u]), -u))
        fresh = {(v, i) for i in range(l) for v in reached(u, i)} - covered
        want.append((u, pytest.approx((k - 1) * n / (own[u][k - 1] + 1) if full else len(own[u]) / l), pytest.approx(len(fresh) / l), not full))
        covered |= fresh
    frame = spark.createDataFrame([(v, i, r) for (v, i), r in rank.items()], "v long, i int, rank long")
    for strategy in ("auto", "rounds"):
        got = greedy.maximize(g, "weighted", 0 if strategy == "auto" else 3, k, l, strategy=strategy, ranks=frame).collect()
        assert [(r["v"], r["est"], r["exact"], r["saturated"]) for r in got] == (want if strategy == "auto" else want[:3])


def test_saturated_seeds_need_no_rounds(many):
    g, _ = many
    got = greedy.maximize(g, "weighted", 2, 600, 2).collect()
    assert [(r["v"], r["est"], r["exact"], r["saturated"]) for r in got] == [(0, 2.0, 2.0, True), (2, 2.0, 2.0, True)]


def test_neighbourhood_sets_lie_in_balls(spark):
    """Every set is made of whole levels of balls around tails of arcs, but for the last ball's draw."""
    rng = random.Random(12)
    g = graph(spark, [(rng.randrange(80), rng.randrange(80)) for _ in range(200)], n=80)
    arcs = [tuple(r) for r in g.arcs.collect()]
    after = {}
    for u, v in arcs:
        after.setdefault(u, set()).add(v)
    runs = [sorted(map(tuple, sampling.neighborhood(g, [1, 6, 30], 4).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    sets = {}
    for size, q, slot, v in runs[0]:
        sets.setdefault((size, q), []).append(v)
    assert len(sets) == 12 and all(len(set(v)) == size for (size, _), v in sets.items())

    def balls(u):
        ball, edge, found = {u}, {u}, [{u}]
        while edge:
            edge = set().union(*(after.get(x, set()) for x in edge)) - ball
            ball = ball | edge
            found.append(set(ball))
        return found

    starts = {u: balls(u) for u in after}
    for (size, _), own in sets.items():
        own = set(own)
        # a ball that is whole in the set, or one that holds the set and whose level before is smaller than it
        assert any((b[-1] <= own) or any(own <= b[i + 1] and len(b[i]) < size for i in range(len(b) - 1)) or own <= b[0] for b in starts.values())


def test_binary_format(spark, tmp_path):
    (tmp_path / "g.gr").write_bytes(binary.encode(5, True, np.array([0, 1, 4]), np.array([1, 2, 0])))
    g = binary.read(spark, str(tmp_path / "g"))
    assert g.n == 5 and sorted(map(tuple, g.arcs.collect())) == [(0, 1), (1, 2), (4, 0)]
    with pytest.raises(ValueError):
        binary.decode(b"x" * 60)


def test_sampling(spark):
    assert sampling.parse_ranges("10-12,1, 5,11") == [1, 5, 10, 11, 12]
    g = graph(spark, [(i, (i + 1) % 30) for i in range(30)])
    got = sampling.neighborhood(g, [3, 8], 4).collect()
    by = {}
    for r in got:
        by.setdefault((r["size"], r["q"]), set()).add(r["v"])
    assert len(by) == 8 and all(len(v) == size for (size, _), v in by.items())


def test_weighted_permutation(spark):
    w = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, weight double")
    p = ranks.weighted(w).cache()
    assert ranks.is_permutation(p, 50)
    assert {r["id"] % 5 for r in p.where("value >= 40").collect()} == {0}


def test_command_line(spark, tmp_path):
    (tmp_path / "g.metis").write_text("4 3\n2 3 4\n\n\n\n")
    gap = cli.run(spark, ["maximize", "-i", str(tmp_path / "g.metis"), "-m", "binary", "-p", "1", "-k", "2", "-l", "2", "-N", "2", "-os", str(tmp_path / "s"), "-oc", str(tmp_path / "c")]).first()
    assert gap["exact"] == 4.0
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert "0_VertexId = 0" in lines and "NumberOfSeedVertices = 1" in lines and len(lines) == 11 + 8
    covered = [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert covered[:2] == ["4", "1"] and covered[3].split("\t")[:2] == ["0", "4.0"] and covered[3].split("\t")[2] == covered[2]
    assert cli.run(spark, ["oracle", "-i", str(tmp_path / "g.metis"), "-a", "-k", "4", "-l", "2"]).count() == 4
    assert cli.run(spark, ["oracle", "-i", str(tmp_path / "g.metis"), "-N", "1-2", "-n", "3", "-k", "4", "-l", "2"]).count() == 2
    cli.run(spark, ["oracle", "-i", str(tmp_path / "g.metis"), "-N", "1-2", "-n", "3", "-k", "4", "-l", "2", "-v", "-os", str(tmp_path / "o")])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines[0] == "NumberOfVertices = 4" and lines[9] == "0_SeedSetSize = 1" and len(lines) == 9 + 2 * (1 + 3 * 6 + 5)
    ids = [x for x in lines if x.startswith("1_2_VertexIds = ")]
    assert len(ids) == 1 and len(ids[0].split(" = ")[1].split(",")) == 2


def chains(spark, lengths):
    """Disjoint chains, one after the other."""
    arcs, at = [], 0
    for length in lengths:
        arcs += [(x, x + 1) for x in range(at, at + length - 1)]
        at += length
    return graph(spark, arcs, n=at)


def test_few_vertices_with_k_pairs_need_no_other_ranks(spark, monkeypatch):
    """Where few vertices have k pairs, theirs are searched; ranks of all the others are not followed."""
    monkeypatch.setattr(greedy, "_reaching", lambda *a: pytest.fail("ranks are followed"))
    g, k, l = chains(spark, [20] + [2] * 150), 30, 2
    own = sorted(r["rank"] for r in ranks.stratified(spark, g.n, l).where("v < 20").collect())
    r = greedy.maximize(g, "binary", 1, k, l, p=1.0).first()
    assert (r["v"], r["est"], r["exact"], r["saturated"]) == (0, pytest.approx((k - 1) * g.n / (own[k - 1] + 1)), 20.0, False)


def test_counts_from_a_floor_that_sinks(spark):
    g, k, l = chains(spark, [40, 30, 12, 11, 5] + [1] * 60), 50, 2
    own = {u: sorted(r["rank"] for r in ranks.stratified(spark, g.n, l).where(f"v >= {u} and v < {u + size}").collect()) for u, size in ((0, 40), (40, 30))}
    first, second = sorted(own, key=lambda u: own[u][k - 1])
    got = greedy.maximize(g, "binary", 6, k, l, p=1.0).collect()
    assert [(r["v"], r["est"]) for r in got[:2]] == [(u, pytest.approx((k - 1) * g.n / (own[u][k - 1] + 1))) for u in (first, second)]
    assert [(r["v"], r["est"], r["exact"], r["saturated"]) for r in got[2:]] == [(70, 12.0, 12.0, True), (82, 11.0, 11.0, True), (93, 5.0, 5.0, True), (98, 1.0, 1.0, True)]


def test_bounds_are_no_less_than_sizes(spark):
    rng = random.Random(14)
    live = live_edges(graph(spark, [(rng.randrange(80), rng.randrange(80)) for _ in range(170)], n=80), "weighted", 5).cache()
    want = sizes(live, spark.range(80).selectExpr("id as q", "id as v"), 5).groupBy("q").agg(F.sum("size").alias("size")).collect()
    most = {r["u"]: r["size"] for r in searches.bounds(pack(live), 5).collect()}
    assert all(r["size"] <= most.get(r["q"], 5) for r in want)
    ring = live_edges(graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)]), "binary", 2, p=1.0)
    assert sorted(map(tuple, searches.bounds(pack(ring), 2).collect())) == [(0, 8), (1, 8), (2, 8), (4, 10)]
