"""Name -> query and name -> SQL for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, build_queries, decision_queries, graph_queries, record_queries, text_queries, vector_queries

MODULES = [graph_queries, build_queries, vector_queries, text_queries, decision_queries, record_queries, answer_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in MODULES for n, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.oracle_sql().items()}
