"""All queries of the llm subpackage, by name."""

from __future__ import annotations

from rollweave.llm import p1_queries, p2_queries, p3_queries, p7_queries, p8_queries, p9_queries, p10_queries

MODULES = (p1_queries, p2_queries, p3_queries, p7_queries, p8_queries, p9_queries, p10_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
