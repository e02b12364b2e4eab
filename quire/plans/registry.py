"""All queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import grouped_queries, region_queries, sql_queries  # noqa: F401  (region_queries registers its queries with grouped_queries)
from quire.plans.dialect import duck_sql, spark_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(sql) for name, sql in sql_queries.QUERIES.items()} | grouped_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(sql) for name, sql in sql_queries.QUERIES.items()} | {name: duck_sql(sql) for name, sql in grouped_queries.ORACLES.items()}
