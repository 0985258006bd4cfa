"""Name -> query, and name -> the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from .operators import classify, extract, layout, overview, records, reports, store_queries, summary, tables, text_queries

_PARTS = (store_queries, text_queries, classify, extract, tables, layout, records, overview, summary, reports)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
