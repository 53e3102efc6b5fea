"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` under ``directory``, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
