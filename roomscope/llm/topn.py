"""The N highest-scoring items of every group.

A histogram of scores per group, counted with map-side combination, gives each large group a lower bound that at least N
of its items reach; items below are dropped, and the rest are ranked exactly by score and id. Groups of up to
``large`` items need no bound. Spark limits the rank per map task before the shuffle, so that even a
group of equal scores sends N rows per task.

Defined cases: rows with a null group, or a null or NaN score, are left out; infinite scores are ordinary; a null id comes last.
Rows with one (group, id) count once, with their highest score. Ties go to the smaller id. Empty input yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per unit of score; bins end at EDGE, where scores still count in order.
BINS, EDGE = 512, 1 << 40


def score_bin(score: Column, bins: int = BINS) -> Column:
    """A monotone bin of any non-NaN double."""
    return F.floor(F.greatest(F.least(score * bins, F.lit(float(EDGE))), F.lit(float(-EDGE)))).cast("bigint")


def thresholds(rows: DataFrame, n: int, large: int, bins: int = BINS) -> DataFrame:
    """For each group of more than ``large`` items, the highest bin from which on it has at least ``n`` of them."""
    counts = rows.groupBy("grp", score_bin(F.col("score"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("items"))
    down = Window.partitionBy("grp").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reach = counts.withColumn("reach", F.sum("items").over(down))
    bound = F.max(F.when(F.col("reach") >= n, F.col("bin")))
    return reach.groupBy("grp").agg(F.sum("items").alias("items"), bound.alias("least_bin")).where(F.col("items") > large).select("grp", "least_bin")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, large: int = 1000, bins: int = BINS) -> DataFrame:
    """grp, item, score, place (from 1) of the ``n`` best items of each group."""
    value = F.col(score).cast("double")
    rows = df.where(F.col(group).isNotNull() & value.isNotNull() & ~F.isnan(value)).select(F.col(group).alias("grp"), F.col(item).alias("item"), value.alias("score"))
    rows = rows.groupBy("grp", "item").agg(F.max("score").alias("score"))
    # of a group with a bound there are more than ``large`` rows, so the bounds are few; adaptive execution broadcasts them below its size limit
    kept = rows.join(thresholds(rows, n, large, bins), "grp", "left").where(F.col("least_bin").isNull() | (score_bin(F.col("score"), bins) >= F.col("least_bin")))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.asc_nulls_last("item")))
    return kept.select("grp", "item", "score", place.alias("place")).where(F.col("place") <= n)
