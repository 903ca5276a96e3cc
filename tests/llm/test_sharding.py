"""Equal texts stay together as far as the shards' counts allow."""

from collections import Counter

import pytest

from cascadia.llm import sharding


def spread(rows, got):
    """Numbers of rows by shard, and the shards of each text."""
    text, where = dict(rows), {}
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    return Counter(r["shard"] for r in got), where


@pytest.mark.parametrize("hot, groups, singles", [(800, 70, 1000), (0, 250, 20), (800, 200, 20)])
def test_groups_that_fit_stay_whole(make, hot, groups, singles):
    texts = ["hot"] * hot + [f"group {g}" for g in range(groups) for _ in range(2 + g % 9)] + [f"single {i}" for i in range(singles)]
    rows = list(enumerate(texts))
    got = sharding.shard(make(rows), 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    counts, where = spread(rows, got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert not [t for t, s in where.items() if len(s) > 1 and t != "hot"]
    assert len(where.get("hot", ())) <= -(-hot // min(counts.values())) + 1


def test_places_use_the_room_exactly():
    found, left, late = sharding.places({30: 1, 7: 5, 2: 4}, [20, 20, 20, 18])
    assert late == 0 and sum(left) == 78 - 73 and min(left) >= 0
    assert Counter(c for c, g0, g1, *_ in found for _ in range(g0, g1))[7] == 5
    assert sum((g1 - g0) * (r1 - r0) for _, g0, g1, r0, r1, _ in found) == 73
    assert sharding.places({6: 2}, [7, 5])[2] == 1
