"""All queries of the engine itself, with their SQL."""

from __future__ import annotations

from procgraph.plans import bpmn_queries, entity_queries, extraction_queries, graph_queries, ingest_queries, layout_queries, runtime_queries, search_queries, session_queries, text_queries, tree_queries, validation_queries  # noqa: F401
from procgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
