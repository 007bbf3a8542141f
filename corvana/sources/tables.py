"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a table is a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
