"""Registry of the library's queries and their DuckDB twins."""

from __future__ import annotations

from lorestone.query_sets import builders, chat, composites, extractors, graph, pipelines, reports, rows, scalars, search, stats, stores

_ALL = {name: pair for module in (search, graph, stats, chat, scalars, rows, composites, pipelines, extractors, builders, stores, reports) for name, pair in module.QUERIES.items()}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
FLAGSHIP = "hybrid_rrf"
