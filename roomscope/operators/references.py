"""References to records that are missing, deleted, or landed only after the referring record.

Both sides are hash-partitioned and sorted on (parent table, key) and merged linearly by a sort-merge join.
The parent side is reduced first to one row per key, its validity interval: the first landing and the latest
deletion entry. The heaviest keys are salted, so that one key with a third of all references is spread.

Defined cases: a null or blank reference is none and yields nothing; every other value is one, also if it has
no letter or digit. Repeated rows count once. Rows without ``loaded_at`` are never late and have a null period.
A parent known only from the deletion log is missing and, if its latest entry is a delete, deleted as well.
Entries with equal times are ordered by ``log_id``. Empty inputs yield no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: References per key from which a key is salted, the most keys salted, and the salts of each.
HOT_ROWS, HOT_KEYS, SALTS = 200_000, 1_000, 32


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^[\s\p{Z}]*$")


def uuid_key(c: Column) -> Column:
    """Letters and digits in lower case: the same for all spellings of one UUID."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def number_key(c: Column) -> Column:
    """The canonical text of a whole number, or the trimmed text of anything else."""
    return F.coalesce(F.trim(c).try_cast("bigint").cast("string"), F.trim(c))



def references(df: DataFrame, table: str, parent: str, record_id: str, ref: str, loaded_at: str, key) -> DataFrame:
    """Non-blank references of one table, in the common form."""
    raw = F.col(ref).cast("string")
    return df.where(~is_blank(raw)).select(
        F.lit(table).alias("table_name"),
        F.lit(parent).alias("parent"),
        F.col(record_id).alias("record_id"),
        key(raw).alias("key"),
        F.col(loaded_at).alias("ref_at"),
    )


def parent_rows(df: DataFrame, parent: str, record_id: str, loaded_at: str, key) -> DataFrame:
    raw = F.col(record_id).cast("string")
    return df.where(raw.isNotNull()).select(
        F.lit(parent).alias("parent"), key(raw).alias("key"), F.lit(True).alias("present"), F.col(loaded_at).alias("at"), F.lit(None).cast("struct<at:timestamp_ntz,no:bigint>").alias("order"), F.lit(None).cast("string").alias("action")
    )


def log_rows(df: DataFrame, table: str, record_key: str, action: str, logged_at: str, log_id: str, keys: dict) -> DataFrame:
    """Entries of the deletion log in the form of parent rows; ``keys`` has the key function of each parent table."""
    raw = F.col(record_key).cast("string")
    key = reduce(lambda rest, p: F.when(F.col(table) == p, keys[p](raw)).otherwise(rest), keys, F.lit(None).cast("string"))
    return df.where(F.col(table).isin(*keys) & raw.isNotNull()).select(
        F.col(table).alias("parent"), key.alias("key"), F.lit(None).cast("boolean").alias("present"), F.lit(None).cast("timestamp_ntz").alias("at"), F.struct(F.col(logged_at).cast("timestamp_ntz").alias("at"), F.col(log_id).cast("bigint").alias("no")).alias("order"), F.lower(F.trim(F.col(action))).alias("action")
    )


def validity(parents: Iterable[DataFrame]) -> DataFrame:
    """One row per parent key: whether a row exists, its first landing, whether the latest entry deletes it."""
    rows = reduce(DataFrame.unionByName, parents)
    return rows.groupBy("parent", "key").agg(
        F.max("present").alias("present"), F.min("at").alias("first_at"), F.max_by("action", "order").alias("last_action")
    )


def find_orphans(refs: Iterable[DataFrame], parents: Iterable[DataFrame], hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS, salts: int = SALTS) -> DataFrame:
    """Every reference that is missing, deleted or late, once: table_name, record_id, key, period and the three flags."""
    refs = reduce(DataFrame.unionByName, refs)
    hot = refs.groupBy("parent", "key").count().where(F.col("count") >= hot_rows).orderBy(F.desc("count"), "parent", "key").limit(hot_keys).select("parent", "key", F.lit(True).alias("hot"))
    hot = F.broadcast(hot)  # at most ``hot_keys`` rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("record_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = refs.join(hot, ["parent", "key"], "left").withColumn("salt", salt).drop("hot")
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    valid = validity(parents).join(hot, ["parent", "key"], "left").withColumn("salt", F.explode(spread)).drop("hot")
    joined = salted.hint("merge").join(valid, ["parent", "key", "salt"], "left")
    return (
        joined.withColumn("missing", F.col("present").isNull())
        .withColumn("deleted", F.coalesce(F.col("last_action") == "delete", F.lit(False)))
        .withColumn("late", F.coalesce(F.col("first_at") > F.col("ref_at"), F.lit(False)))
        .where("missing or deleted or late")
        .select("table_name", "record_id", "key", F.date_format("ref_at", "yyyy-MM").alias("period"), "missing", "deleted", "late")
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table and month, by kind; a record of several kinds counts in each."""
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return found.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("orphans"), count("missing"), count("deleted"), count("late"))
