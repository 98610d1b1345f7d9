"""Landed raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesift.schema import PAGE


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a parquet file or directory. Only the columns a job uses are
    read, and filters reach the scan."""
    return spark.read.schema(PAGE).parquet(path)
