"""Queries over the derived contract tables, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactlake.plans import score_queries, text_queries

FLAGSHIP = "R16_score_documents"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = score_queries.QUERIES | text_queries.QUERIES
ORACLES: dict[str, str] = score_queries.ORACLES | text_queries.ORACLES
