"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import analysis_queries, content_queries, line_queries, text_queries, workflow_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = text_queries.Q | workflow_queries.Q | line_queries.Q | content_queries.Q | analysis_queries.Q
ORACLE_SQL: dict[str, str] = text_queries.S | workflow_queries.S | line_queries.S | content_queries.S | analysis_queries.S
