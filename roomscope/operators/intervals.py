"""Continuous periods of overlapping intervals per entity, and the gaps between them.

``session_window`` with each row's own duration merges overlapping intervals natively. It runs twice: first within
(entity, slice of time), where an entity of very many rows has as many slices as those need, then per entity over what is left.
Periods that only touch are joined after that, and gaps come from ``lead``.

Defined cases: times are rounded half up to whole milliseconds; rows with a null, NaN or infinite time, or an end not
after the start, are left out. Rows with one id count once. A null entity is an entity of its own. Empty input yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an entity from which its time is cut into slices, each of about so many rows.
SLICE_ROWS = 50_000
#: Times beyond this many seconds have no timestamp that Spark can hold.
LIMIT_S = 9.0e12


def whole_ms(c: Column) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT_S)
    return F.when(ok, F.round(c * 1000).cast("bigint"))


def intervals(df: DataFrame, record_id: str, entity: str, start: str, end: str) -> DataFrame:
    """Valid intervals in milliseconds, one per record."""
    return (
        df.select(F.col(record_id).alias("record_id"), F.col(entity).alias("entity"), whole_ms(F.col(start).cast("double")).alias("start_ms"), whole_ms(F.col(end).cast("double")).alias("end_ms"))
        .where("end_ms > start_ms")
        .dropDuplicates(["record_id", "entity", "start_ms", "end_ms"])
    )


def _sessions(rows: DataFrame, *keys: str) -> DataFrame:
    """Merge overlapping rows (start_ms, end_ms, covered) of each key."""
    length = F.concat((F.col("end_ms") - F.col("start_ms")).cast("string"), F.lit(" milliseconds"))
    merged = rows.withColumn("at", F.timestamp_millis("start_ms")).groupBy(*keys, F.session_window("at", length).alias("w"))
    return merged.agg(F.sum("covered").alias("covered")).select(*keys, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "covered")


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``part``: for an entity of many rows, the slice of its time by start; its slices are equally long, and so many that one has ``slice_rows`` rows if starts are spread evenly."""
    large = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("low"), F.max("start_ms").alias("high")).where(F.col("n") > slice_rows)
    width = F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) * slice_rows / F.col("n")))
    large = large.select(F.col("entity").alias("big"), "low", width.alias("width"))
    return rows.join(large, F.col("entity").eqNullSafe(F.col("big")), "left").withColumn("part", F.coalesce(F.floor((F.col("start_ms") - F.col("low")) / F.col("width")), F.lit(0))).drop("big", "low", "width")


def periods(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """entity, start_ms, end_ms, overlapping: one row per continuous period of ``intervals``.

    A period overlaps somewhere exactly if its intervals are longer together than it is.
    """
    rows = _sliced(rows.select("entity", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("covered")), slice_rows)
    merged = _sessions(_sessions(rows, "entity", "part"), "entity")
    in_order = Window.partitionBy("entity").orderBy("start_ms")
    fresh = F.when(F.lag("end_ms").over(in_order) >= F.col("start_ms"), 0).otherwise(1)
    numbered = merged.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(in_order))
    joined = numbered.groupBy("entity", "no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("covered").alias("covered"))
    return joined.select("entity", "start_ms", "end_ms", (F.col("covered") > F.col("end_ms") - F.col("start_ms")).alias("overlapping"))


def merged_and_gaps(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """entity, kind, start_ms, end_ms: 'merged' for each period with an overlap, 'gap' for each hole between periods."""
    follow = F.lead("start_ms").over(Window.partitionBy("entity").orderBy("start_ms"))
    both = periods(rows, slice_rows).withColumn("next_ms", follow).select(
        "entity",
        F.explode(
            F.array(
                F.when(F.col("overlapping"), F.struct(F.lit("merged").alias("kind"), "start_ms", "end_ms")),
                F.when(F.col("next_ms").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("end_ms").alias("start_ms"), F.col("next_ms").alias("end_ms"))),
            )
        ).alias("x"),
    )
    return both.where("x is not null").select("entity", "x.kind", "x.start_ms", "x.end_ms")
