"""All queries of the library but for the llm subpackage's, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import agent_queries, analysis_queries, bookkeeping_queries, compare_queries, document_queries, fulltext_queries, range_queries, reading_queries, relational_queries, retrieval_queries, stream_queries, structure_queries, verification_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (agent_queries, analysis_queries, bookkeeping_queries, verification_queries, range_queries, structure_queries, retrieval_queries, fulltext_queries, compare_queries, document_queries, stream_queries, relational_queries, reading_queries)
QUERIES: dict[str, Query] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
