"""Functions of tables and of groups, for what expressions can't say; registered by name for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType


@F.udtf(returnType=StructType().add("place", IntegerType()).add("entry", StringType()))
class SplitList:
    """A row for each entry of a comma list, trimmed; blank entries and a null list give none."""

    def eval(self, text: str):
        for k, entry in enumerate((text or "").split(",")):
            if entry.strip():
                yield k + 1, entry.strip()


@F.pandas_udf(DoubleType())
def middle(values: pd.Series) -> float:
    """The median of a group without nulls and NaN; for groups that fit into a task."""
    return float(values.dropna().median()) if values.notna().any() else float("nan")


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_list", SplitList)
    spark.udf.register("middle", middle)
