"""Parquet tables of one directory, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; columns and filters are pushed into its scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
