"""The queries over the knowledge-graph views, by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramite.plans import goal_queries, graph_queries, memory_queries, record_queries

_MODULES = (graph_queries, memory_queries, goal_queries, record_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
