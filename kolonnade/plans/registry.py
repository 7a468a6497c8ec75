"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kolonnade.plans import core_queries, ledger_queries, profile_queries, serving_queries  # noqa: F401


def queries() -> dict:
    return dict(core_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(core_queries.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["value_collision_candidates"](spark, sf_dir)
