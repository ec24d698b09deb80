"""Stages of a pipeline as stored tables, so that a run can start anew from any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(spark: SparkSession, source: DataFrame, stages: list[Stage], folder: str, start: int = 0) -> DataFrame:
    """Run the stages from number ``start`` on, each over the stored result of the one before, and store each result below ``folder``."""
    now = spark.read.parquet(f"{folder}/{stages[start - 1][0]}") if start else source
    for name, stage in stages[start:]:
        stage(now).write.mode("overwrite").parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    return now


def not_cached(wanted: DataFrame, cached: DataFrame, key: str, now: str) -> DataFrame:
    """The rows of ``wanted`` whose ``key`` has no entry (key, expires_at) in ``cached`` that is valid after ``now``."""
    return wanted.join(cached.where(f"expires_at > TIMESTAMP '{now}'").select(key).distinct(), key, "left_anti")
