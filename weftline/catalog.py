"""All queries over the test tables, with SQL for a second engine."""

from __future__ import annotations

from .plans import aggregate_queries, graph_queries, join_queries, lookup_queries, resolve_queries, text_queries, version_queries


def bigint_counts(sql: str) -> str:
    """count_if(x), which is a 128-bit sum in the second engine, as a count with a filter."""
    at = sql.find("count_if(")
    if at < 0:
        return sql
    start, depth, end = at + len("count_if("), 1, at + len("count_if(")
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    return f"{sql[:at]}count(*) filter (where {sql[start : end - 1]}){bigint_counts(sql[end:])}"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (graph_queries, join_queries, resolve_queries, lookup_queries, aggregate_queries, text_queries, version_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= {name: bigint_counts(sql) for name, sql in _module.SQL.items()}
