"""All registered queries of the core and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.plans import article_queries, index_queries, nested_queries, relational_queries, text_queries

MODULES = (text_queries, index_queries, article_queries, nested_queries, relational_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search: dense and sparse rankings of the same queries, fused."""
    return index_queries.hybrid_rrf(spark, folder)
