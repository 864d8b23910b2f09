"""Every registered query of the library and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregate_queries, change_queries, graph_queries, knowledge_queries, log_queries, relation_queries, search_queries, service_queries, store_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
