"""All queries of this subpackage, and their SQL counterparts."""

from __future__ import annotations

from weftgraph.llm import queries as q
from weftgraph.llm import sql
from weftgraph.session import shipped


def queries() -> dict:
    return {name: shipped(f) for name, f in q.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
