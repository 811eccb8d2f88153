"""The registry of queries: each has a name, a function of (spark, sf_dir), and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Imports every module of queries."""
    from memlake.plans import answer_queries, build_queries, graph_queries, index_queries, listing_queries, memory_queries, parsing_queries, retrieval_queries, source_queries, store_queries, stream_queries, text_queries, vector_queries  # noqa: F401
