"""Filling fixed-capacity containers with items, by vector best fit.

Every container has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are taken
from the largest down; of the open containers in which a piece fits under every capacity, the one whose weighted residual
vector has the smallest norm afterwards gets it, the first of equals. A text longer than a container is cut into full containers
and a rest; nothing else is split.

The items are hashed into blocks of bounded size that are packed side by side. The poorly filled containers of up to MERGED blocks, at
most ``carry`` items of each, are then opened and packed again together, until one block is left.

Defined cases: items of no tokens take a document's place and no room; a null size counts as none. Repeated rows of one
(id, size) count once. A null id is an item. Empty input gives no containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY, MAX_DOCS = 2048, 1024
BLOCK_ITEMS, MERGED, CARRY, MOST_TASKS = 20_000, 64, 1_500, 10_000
#: Weights of tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.05, 0.05)
#: Containers filled below this share may be packed again.
FULL = 0.998
SCHEMA = "container_id bigint, doc_ids array<bigint>, sizes array<bigint>, tokens bigint, again boolean"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: float | None = None, weights: Iterable[float] = WEIGHTS) -> np.ndarray:
    """The container of each piece; no piece may exceed ``capacity``."""
    attention = float(capacity) ** 2 if attention is None else attention
    wt, wd, wa = weights
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    least = float(sizes[order[-1]]) if len(order) else 0.0
    closed: list[tuple[int, int]] = []  # containers and the documents that they could still hold
    home = np.empty(len(sizes), np.int64)
    room = np.empty((3, 64))  # open containers only: tokens, documents, attention
    number = np.empty(64, np.int64)
    count = made = 0
    for i in order:
        s = float(sizes[i])
        t, d, a = room[0, :count], room[1, :count], room[2, :count]
        fits = np.flatnonzero((t >= s) & (d >= 1) & (a >= s * s))
        if len(fits):
            left = wt * ((t[fits] - s) / capacity) ** 2 + wd * ((d[fits] - 1) / max_docs) ** 2 + wa * ((a[fits] - s * s) / attention) ** 2
            k = int(fits[np.argmin(left)])
        else:
            if count == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            k, count = count, count + 1
            room[:, k] = capacity, max_docs, attention
            number[k] = made
            made += 1
        room[:, k] -= s, 1, s * s
        home[i] = number[k]
        if room[1, k] < 1 or room[0, k] < least or room[2, k] < least * least:  # nothing more fits
            closed.append((int(number[k]), int(room[1, k]) if room[2, k] >= 0 else 0))
            count -= 1
            room[:, k], number[k] = room[:, count], number[count]
    empty = np.flatnonzero(sizes <= 0)  # need a document's place only
    places = np.repeat(*(np.array(v, np.int64) for v in zip(*closed, *((int(number[k]), int(room[1, k])) for k in range(count)), strict=True))) if made else np.empty(0, np.int64)
    more = max(0, len(empty) - len(places))
    home[empty] = np.concatenate([places[: len(empty)], made + np.arange(more) // max_docs])
    return home


def pack(ids: list, sizes: list[int], first_id: int, capacity: int, max_docs: int, attention: float | None, carry: int) -> list[dict]:
    """The containers of one block; ``again`` marks those to be packed again, with ``carry`` items at most."""
    out, piece_ids, pieces = [], [], []
    for i, n in dict.fromkeys(zip(ids, (s or 0 for s in sizes), strict=True)):
        for _ in range((n - 1) // capacity if n > capacity else 0):
            out.append({"doc_ids": [i], "sizes": [capacity], "tokens": capacity, "again": False})
        piece_ids.append(i)
        pieces.append((n - 1) % capacity + 1 if n > capacity else n)
    homes = best_fit(np.array(pieces, dtype=np.int64), capacity, max_docs, attention)
    bins: dict[int, dict] = {}
    for i, n, h in zip(piece_ids, pieces, homes.tolist(), strict=True):
        b = bins.setdefault(h, {"doc_ids": [], "sizes": [], "tokens": 0, "again": False})
        b["doc_ids"].append(i)
        b["sizes"].append(n)
        b["tokens"] += n
    left = carry
    for b in sorted(bins.values(), key=lambda b: b["tokens"]):
        left -= len(b["sizes"])
        if left < 0 or b["tokens"] >= FULL * capacity:
            break
        b["again"] = True
    out += bins.values()
    return [{"container_id": first_id + k, **b} for k, b in enumerate(out)]


def pack_containers(items: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: float | None = None, block_items: int = BLOCK_ITEMS, carry: int = CARRY) -> DataFrame:
    """container_id, doc_ids, sizes, tokens of the containers of ``items`` (doc_id bigint, size bigint)."""
    arrow = pa.schema([("container_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.int64()), ("again", pa.bool_())])

    def packed(rows: DataFrame, level: int, blocks: int, last: bool) -> DataFrame:
        def run(key, table):
            ids, sizes = table["doc_id"].to_pylist(), table["size"].to_pylist()
            first = (level << 58) + (key[0].as_py() << 26)
            return pa.Table.from_pylist(pack(ids, sizes, first, capacity, max_docs, attention, 0 if last else carry), schema=arrow)

        tasks = min(MOST_TASKS, blocks)
        return rows.repartition(tasks, "block").groupBy("block").applyInArrow(run, SCHEMA)  # by their number, as packing costs time, not bytes

    blocks = max(1, math.ceil(items.count() / block_items))
    rows = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)))
    done, level = [], 0
    while True:
        made = packed(rows, level, blocks, blocks == 1)
        if blocks == 1:
            done.append(made)
            break
        made = cut_lineage(made)
        done.append(made.where("not again"))
        blocks, level = math.ceil(blocks / MERGED), level + 1
        again = F.floor(F.shiftright(F.col("container_id").bitwiseAND(F.lit((1 << 58) - 1)), 26) / MERGED)
        rows = made.where("again").select(F.explode(F.arrays_zip("doc_ids", "sizes")).alias("x"), again.alias("block")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("size"), "block")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("again")
