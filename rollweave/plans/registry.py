"""All queries of the core, by name."""

from __future__ import annotations

from rollweave.plans import p4_queries, p5_queries, p6_queries, record_queries, value_queries

MODULES = (record_queries, value_queries, p4_queries, p5_queries, p6_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
