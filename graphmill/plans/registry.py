"""All registered queries of the engine, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import architecture_queries, graph_queries, impact_queries, retrieval_queries, search_queries, source_queries, stream_queries, telemetry_queries, upkeep_queries

PARTS = (architecture_queries, graph_queries, retrieval_queries, telemetry_queries, search_queries, impact_queries, upkeep_queries, source_queries, stream_queries)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
