"""Objects by key: listing, existence, bytes; and writing of tables and objects."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import object_key


def objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content below a folder; content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def listing(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    """The first ``n`` keys with their sizes."""
    return objects(spark, folder).select("path", "length").orderBy("path").limit(n)


def bare_path(c: Column) -> Column:
    """A path without scheme and host, with single slashes."""
    return F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")


def with_existence(rows: DataFrame, key: str, listed: DataFrame, folder: str) -> DataFrame:
    """Adds ``there``: whether the key, bare or as ``s3://bucket/key``, has an object in ``listed``, the objects below ``folder``. Rows and their order stay; a null key has none."""
    root = F.concat(F.regexp_replace(bare_path(F.lit(folder)), "/$", ""), F.lit("/"))
    path = bare_path(F.col("path"))
    known = listed.where(F.startswith(path, root)).select(F.substr(path, F.length(root) + 1).alias("__key"), F.lit(True).alias("__there")).distinct()
    joined = rows.withColumn("__own", object_key(F.col(key))).join(known, F.col("__own") == F.col("__key"), "left")
    return joined.withColumn("there", F.coalesce("__there", F.lit(False))).drop("__own", "__key", "__there")


def decoded(blobs: DataFrame, decode: Callable[[bytes], Any], kind: str) -> DataFrame:
    """Adds ``value`` of type ``kind``: what ``decode`` makes of each object's content, null where it fails or the content is null. The decoder is given, as none is built in."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(content):
            try:
                return None if content is None else decode(bytes(content))
            except Exception:  # a broken object isn't the batch's failure
                return None

        for contents in batches:
            yield pd.Series([one(c) for c in contents], index=contents.index, dtype="object")

    return blobs.withColumn("value", run(F.col("content")))


def write_blobs(df: DataFrame, key: str, content: str, folder: str) -> DataFrame:
    """Write each row's bytes to ``folder``/key, a folder that all executors share, and give the key and the uri written. A repeated key is written anew; keys that leave the folder are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = os.path.abspath(folder)
        for rows in batches:
            out = []
            for k, data in zip(rows["key"], rows["content"], strict=True):
                path = os.path.abspath(os.path.join(root, k))
                if not path.startswith(root + os.sep):
                    raise ValueError(f"the key {k!r} leaves the folder")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(bytes(data))
                os.replace(part, path)  # whole or not at all, also if the task runs twice
                out.append((k, f"file://{path}"))
            yield pd.DataFrame(out, columns=["key", "uri"])

    return df.select(F.col(key).alias("key"), F.col(content).alias("content")).where("key is not null and content is not null").mapInPandas(run, "key string, uri string")


def append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_parts(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` has, so that a repeated run doesn't double rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON message per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, typed by ``schema``; values that don't fit are null."""
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def write_orc(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).orc(path)
