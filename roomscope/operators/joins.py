"""Joins on ranges as equi-joins on buckets, and folds of events onto records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, span_s: int) -> DataFrame:
    """Pairs of rows of one key of which the right one comes at or up to ``span_s`` seconds after the left; columns of both as l and r.

    Times are cut into buckets of the span; a left row goes to its bucket and the next, so that the join is on (key, bucket). Rows of a null key or time have no partner.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (span_s * 1_000_000))
    l = left.withColumn("__b", F.explode(F.array(bucket(at_left), bucket(at_left) + 1)))
    r = right.withColumn("__b", bucket(at_right))
    apart = F.unix_micros(F.col(f"r.{at_right}").cast("timestamp")) - F.unix_micros(F.col(f"l.{at_left}").cast("timestamp"))
    return l.alias("l").join(r.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.__b") == F.col("r.__b"))).where((apart >= 0) & (apart <= span_s * 1_000_000))


def latest_by(events: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key by ``order``, and how many events it has: the state of a log that is only appended to."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("events"))


def fold_edits(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows (key, order_index, in_time, out_time) after edits (key, seq, op, value): 'remove' and 'restore', 'move' to an index, 'trim' to seconds from the start.

    Of each kind the last edit of a row counts, so the fold is one aggregation, and edits may come in any order.
    """
    last = lambda *ops: F.max_by(F.struct("op", "value"), F.when(F.col("op").isin(*ops), F.col("seq")))
    done = edits.groupBy(key).agg(last("remove", "restore").alias("there"), last("move").alias("move"), last("trim").alias("trim"))
    joined = rows.join(done, key, "left").where(F.coalesce(F.col("there.op"), F.lit("")) != "remove")
    return joined.select(key, F.coalesce(F.col("move.value").cast("int"), F.col("order_index")).alias("order_index"), "in_time", F.coalesce(F.least("out_time", F.col("in_time") + F.col("trim.value")), "out_time").alias("out_time"))


def grouped_ids(rows: DataFrame, record_id: str, *group: str) -> DataFrame:
    """Each record with the id of its group, the least record id in it, and the group's size: ids that a repeated run gives again."""
    made = rows.groupBy(*group).agg(F.min(record_id).alias("group_id"), F.count(F.lit(1)).alias("size"))
    same = None
    right = made.select(*[F.col(c).alias(f"__{c}") for c in group], "group_id", "size")
    for c in group:
        on: Column = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = on if same is None else same & on
    return rows.join(right, same).drop(*[f"__{c}" for c in group])


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order that has no ties."""
    return rows.orderBy(*order).limit(n)


def nearest_of(values: Column, at: Column) -> Column:
    """The element of an array nearest to ``at``, the smaller of two; null where there is none."""
    good = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.array_min(F.transform(good, lambda v: F.struct(F.abs(v - at).alias("d"), v.alias("v"))))["v"]


