"""All queries of the engine and their SQL."""

from __future__ import annotations

from millrace.plans import api_queries, crawl_queries, log_queries, search_queries, turn_queries

_PARTS = (search_queries, log_queries, crawl_queries, api_queries, turn_queries)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
