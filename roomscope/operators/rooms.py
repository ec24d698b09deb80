"""Room groups of photos: sub-clusters by nearness of vectors, and their metrics.

Within (job, label), photos whose cosine distance is at most ``eps`` are linked, and linked photos are one cluster. A group
with a vector missing or broken isn't divided. Groups are cut into blocks of ``block`` rows; pairs of blocks are compared by matrix products, each
giving a forest of links only, and the forests are joined as components. A group of one block is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

BLOCK = 2_000


def forest(ids: np.ndarray, x: np.ndarray, ids2: np.ndarray, y: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links that connect what the pairs of x and y of at least ``least`` connect."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = a = parent.setdefault(p, p)
        return a

    u, v = [], []
    for s in range(0, len(x), 512):
        i, j = np.nonzero(np.round(x[s : s + 512] @ y.T, 9) >= least)
        for a, b in zip(ids[s + i].tolist(), ids2[j].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                u.append(max(a, b))
                v.append(min(a, b))
    return u, v


def sub_clusters(photos: DataFrame, eps: float = 0.3, block: int = BLOCK) -> DataFrame:
    """id, job_id, label, first_id: the cluster of each photo, named by its least id. Photos: id, job_id, label, x (array<double>)."""
    valid = F.coalesce((F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0), F.lit(False))
    length = F.when(valid, F.size("x")).otherwise(F.lit(0))
    checked = photos.withColumn("n", length)
    group = checked.groupBy("job_id", "label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))
    kind = group.select("job_id", "label", ((F.col("least") > 0) & (F.col("least") == F.col("most")) & (F.col("rows") > 1)).alias("divided"), F.ceil(F.col("rows") / block).cast("int").alias("blocks"), F.col("first_id").alias("group_first"))
    rows = checked.join(kind, ["job_id", "label"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("a"), F.greatest(k, F.col("own")).alias("b")))
    tiled = rows.where("divided").withColumn("own", own).select("id", "x", "own", "job_id", "label", F.explode(tiles).alias("t"))

    def run(key, t):
        at, ids = t["own"].to_numpy(), t["id"].to_numpy()
        x = np.array(t["x"].to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = at == key[2].as_py(), at == key[3].as_py()
        u, v = forest(ids[a], x[a], ids[b], x[b], 1 - eps)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    edges = tiled.select("id", "x", "own", "job_id", "label", F.col("t.a").alias("a"), F.col("t.b").alias("b")).groupBy("job_id", "label", "a", "b").applyInArrow(run, "u bigint, v bigint")
    roots = components(edges).select(F.col("u").alias("id"), "root")
    first = F.when(F.col("divided"), F.coalesce("root", "id")).otherwise(F.col("group_first"))
    return rows.join(roots, "id", "left").select("id", "job_id", "label", first.alias("first_id"))


def numbered(clusters: DataFrame) -> DataFrame:
    """Adds ``cluster_seq``: clusters of a job counted from 1, labels in order of their first id, then clusters of theirs."""
    label_first = F.min("first_id").over(Window.partitionBy("job_id", "label"))
    order = Window.partitionBy("job_id").orderBy("label_first", "label", "first_id")
    return clusters.withColumn("label_first", label_first).withColumn("cluster_seq", F.dense_rank().over(order)).drop("label_first")
