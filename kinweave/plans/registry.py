"""All queries of the core library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans import evidence_queries, import_queries, problems, text_queries, tree_queries

MODULES = (problems, tree_queries, text_queries, import_queries, evidence_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return tree_queries.b_ancestors(spark, directory)
