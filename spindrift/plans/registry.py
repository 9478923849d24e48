"""All registered queries of the retrieval engine, with the DuckDB SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, search_queries, store_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return search_queries.QUERIES | engine_queries.QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return search_queries.SQL | engine_queries.SQL | store_queries.SQL
