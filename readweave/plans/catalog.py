"""All queries of the core package, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readweave.plans import problems, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | reference.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems.SQL | reference.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.summary_table(spark, sf_dir)
