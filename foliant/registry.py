"""Registered queries of the document-format operators and their SQL."""

from __future__ import annotations

from foliant.plans import log_queries, package_queries, table_queries, template_queries, text_queries

_PARTS = (text_queries, table_queries, template_queries, log_queries, package_queries)
QUERIES: dict = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
