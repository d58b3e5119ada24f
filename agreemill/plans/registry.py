"""All registered evaluation queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agreemill.plans import query_others, query_pairs, query_ratings, query_tables

MODULES = (query_pairs, query_ratings, query_others, query_tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
