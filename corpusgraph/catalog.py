"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from corpusgraph.plans import REGISTRY, flow_queries, more_queries, ops_queries, store_queries, text_queries, vector_queries, workflow_queries  # noqa: F401  (the modules register their queries)


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
