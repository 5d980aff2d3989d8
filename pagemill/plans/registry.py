"""All queries of the library's own operators, bound to the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, coverage_queries, image_queries, layout_queries, note_queries, page_queries, structure_queries, usage_queries

_MODULES = (coverage_queries, page_queries, image_queries, corpus_queries, usage_queries, structure_queries, layout_queries, note_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
