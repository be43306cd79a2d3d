"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
