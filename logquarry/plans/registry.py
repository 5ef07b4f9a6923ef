"""All registered log queries and their SQL."""

from __future__ import annotations

from logquarry.plans import format_queries, log_queries

QUERIES = log_queries.QUERIES | format_queries.QUERIES
SQL = log_queries.SQL | format_queries.SQL
