"""All queries on the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from tessaly.plans import cs_queries, engine_queries, futures_queries, market_queries, research_queries, ts_queries

_PARTS = (ts_queries, cs_queries, engine_queries, market_queries, research_queries, futures_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
