"""The engine's queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codehealth.plans import source_queries, table_queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health report of the supplier graph."""
    return table_queries.health_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return table_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return table_queries.SQL | source_queries.SQL
