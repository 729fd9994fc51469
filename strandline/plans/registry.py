"""The queries that __spark_entry__ registers for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment_queries, call_queries, interval_queries, pipeline_queries

MODULES = (interval_queries, alignment_queries, call_queries, pipeline_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth per bin, sample and chromosome."""
    return interval_queries.depth_per_bin(spark, sf_dir)
