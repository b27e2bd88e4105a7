"""All queries of the core, and their SQL counterparts."""

from __future__ import annotations

from weftgraph.plans import change_queries, connector_queries, engine_queries, general, general_sql, graph_queries, retrieval_queries
from weftgraph.session import shipped


def queries() -> dict:
    return {name: shipped(f) for name, f in (general.QUERIES | graph_queries.QUERIES | retrieval_queries.QUERIES | change_queries.QUERIES | connector_queries.QUERIES | engine_queries.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return general_sql.SQL | graph_queries.SQL | retrieval_queries.SQL | change_queries.SQL | connector_queries.SQL | engine_queries.SQL
