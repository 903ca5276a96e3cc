"""Live-edge instances of the Independent Cascade model: which arcs are live in which of l sample worlds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadia.functions.hashing import RESOLUTION, finish, pair_state
from cascadia.operators.graph import Graph

SEED, INSTANCES = 31101982, 64


def weighted(h: Column, indeg: Column, p: float) -> Column:
    """Probability 1 / in-degree of the head."""
    return F.least(F.lit(RESOLUTION), F.floor(F.lit(RESOLUTION) / indeg))


def binary(h: Column, indeg: Column, p: float) -> Column:
    """Probability p for all arcs."""
    return F.lit(int(p * RESOLUTION))


def trivalency(h: Column, indeg: Column, p: float) -> Column:
    """One of 0.1, 0.01 and 0.001, drawn for each arc and instance."""
    return F.element_at(F.array(*[F.lit(RESOLUTION // x) for x in (10, 100, 1000)]), (h % 3 + 1).cast("int"))


#: Models by name: a threshold for the hash. Others can be added.
MODELS = {"weighted": weighted, "binary": binary, "trivalency": trivalency}


def live_edges(graph: Graph, model: str = "weighted", l: int = INSTANCES, seed: int = SEED, p: float = 0.1) -> DataFrame:  # noqa: E741
    """i, src, dst of every live arc in each of l instances; a function of the arguments alone.

    Two words of the hash are folded once an arc, the third for each instance; the in-degree is only looked up for
    models that use it. The seed's upper 16 bits of 32 do not matter. Unknown models raise.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(sorted(MODELS))}")
    if not 1 <= l <= 65535:
        raise ValueError("l is 1 to 65535")
    arcs = graph.arcs
    if model == "weighted":
        arcs = arcs.join(graph.in_degrees(), "dst")
    else:
        arcs = arcs.withColumn("indeg", F.lit(1).cast("long"))
    arcs = pair_state(arcs, "src", "dst", l, seed, "state")
    worlds = arcs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(l - 1))))
    h = finish(worlds, "state", "i", "h")
    return h.where(F.pmod("h", F.lit(RESOLUTION)) < MODELS[model](F.col("h"), F.col("indeg"), p)).select("i", "src", "dst")
