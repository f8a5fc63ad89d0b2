"""The registered queries over the versioned-tree operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import branch_queries, feed_queries, merge_queries, object_queries, trace_queries, tree_queries

MODULES = (tree_queries, merge_queries, object_queries, trace_queries, feed_queries, branch_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
