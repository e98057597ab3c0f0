"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; the splits are left to the reader's settings."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
