"""All queries of the engine's own operators, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import catalog, graph_queries, service_queries, sources_and_columns, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["d5_level_counts"](spark, sf_dir)


def queries() -> dict:
    return catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.SQL
