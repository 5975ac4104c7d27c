"""All core queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.plans import graph_queries, problem_queries, store_queries


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return graph_queries.trade_match(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**graph_queries.QUERIES, **store_queries.QUERIES, **problem_queries.QUERIES}


def oracles() -> dict[str, str]:
    return {**graph_queries.ORACLES, **store_queries.ORACLES, **problem_queries.ORACLES}
