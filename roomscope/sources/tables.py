"""Readers for the table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; a file or a folder."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
