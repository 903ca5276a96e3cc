"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from cascadia.llm import extraction, licenses, mixing, near_vectors, neighbours, packing, set_join, sharding, substrings, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            extraction.op1_extraction,
            packing.op2_packing,
            substrings.op3_substrings,
            sharding.op4_sharding,
            toxicity.op5_toxicity,
            mixing.op6_mixing,
            set_join.op7_set_join,
            licenses.op8_licenses,
            neighbours.op9_neighbours,
            near_vectors.op10_near_vectors,
        )
    }


def oracle_sql() -> dict:
    return {"op3_substrings": substrings.ORACLE, "op6_mixing": mixing.ORACLE, "op7_set_join": set_join.ORACLE, "op10_near_vectors": near_vectors.ORACLE}
