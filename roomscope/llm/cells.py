"""Vectors brought together in cells, so that similar ones meet in one task.

Bisecting k-means over a bounded sample gives the cells' centres: the node of largest dispersion is split until there are as many nodes as cells of about
``cell_rows`` rows are needed. Every valid vector goes to its nearest cell. A cell of many more rows than that, such as one of a dense group that
the dispersion doesn't split, is divided into blocks by a hash of the vector.

Two vectors on both sides of a border together are as far from it as they are apart across it, so one of them is within half of that. A vector visits every cell whose
border is within ``reach``: half of the distance that two vectors of the floor's cosine can have at all, which proves that every such pair meets, or half
of what ``DEVIATIONS`` standard deviations of it across a border of random direction cover. Neither the number of cells nor how many rows lie elsewhere counts.
Without a floor, a vector goes to so many nearest cells that held-out rows find their true nearest.

Equal vectors of a chunk of rows travel once, with the smallest of their ids; the others go along as rows naming their representative.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
#: Rows of a cell, and of the smallest cells that are made for more cores; rows of the sample for each cell, and the least and most rows of the sample.
LEAST_ROWS = 5_000
CELL_ROWS, ROWS_PER_CELL, SAMPLE_ROWS, MOST_SAMPLE = 40_000, 32, 32_000, 400_000
#: Standard deviations of the way across a border, in random direction, that the reach covers; recall and rows by which probes are set.
DEVIATIONS, RECALL, PROBE_ROWS = 4.25, 0.98, 2_000
#: Rows among which equal vectors are put together before the shuffle.
CHUNK_ROWS = 100_000
ROUTED = "cell bigint, block int, member boolean, asks boolean, id bigint, ids array<bigint>, vec binary, copy bigint"


@dataclass(frozen=True)
class Cells:
    """Unit centres, the sine of the angle to its border within which a cell is visited, or if not 0 the number of nearest cells visited, and the blocks of each cell."""

    centres: np.ndarray
    reach: float
    probes: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The valid vectors of a list column and their row numbers: ``dim`` finite elements, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.empty((0, dim), np.float32), np.empty(0, np.int64)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return np.ascontiguousarray(flat[good]), rows[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled first, so that no square is lost."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each vector; equal ones have the same."""
    words = np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64)  # -0 is 0
    odd = np.random.default_rng(11).integers(1, 2**63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    return (words * odd).sum(axis=1, dtype=np.uint64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and the number of its distinct vector for each row."""
    x = x + np.float32(0)
    _, first, which = np.unique(hashes(x), return_index=True, return_inverse=True)
    if len(x) and not (x[first[which]] == x).all():  # two vectors of one hash
        _, first, which = np.unique(np.ascontiguousarray(x).view(f"V{4 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


def blobs(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def joined(column: pa.ChunkedArray) -> bytes:
    """The bytes of a binary column, one after the other."""
    return b"".join(column.drop_null().to_pylist())


def bisect(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of ``cells`` nodes of unit rows; the node of largest dispersion is split first."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray) -> tuple[float, int, np.ndarray]:
        return float(np.linalg.norm(sample[rows].sum(axis=0))) - len(rows), int(rows[0]), rows

    heap = [node(np.arange(len(sample)))]
    done: list[np.ndarray] = []
    while heap and len(heap) + len(done) < cells:
        rows = heapq.heappop(heap)[2]
        if len(rows) < 2:
            done.append(rows)
            continue
        x = sample[rows]
        two = x[rng.choice(len(x), 2, replace=False)]
        side = np.arange(len(x)) % 2 == 0
        for _ in range(6):
            now = x @ (two[0] - two[1]) > 0
            if now.all() or not now.any():
                break
            side = now
            two = np.stack([x[side].sum(axis=0), x[~side].sum(axis=0)])
            two /= np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-12)
        for part in (rows[side], rows[~side]):
            heapq.heappush(heap, node(part))
    sums = np.stack([sample[r].sum(axis=0) for r in [*(h[2] for h in heap), *done]])
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in pieces of bounded memory."""
    step = max(1, 16_000_000 // len(centres))
    return np.concatenate([np.argmax(x[s : s + step] @ centres.T, axis=1) for s in range(0, len(x), step)] or [np.empty(0, np.int64)])


def beyond(score: np.ndarray, home: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sine of the angle of each row to the border between its ``home`` and each cell, given its scores."""
    own, which = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 1e-12))
    return (score[np.arange(len(score)), home][:, None] - score) / apart[which.ravel()]


def probes_for(held: np.ndarray, sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The nearest cells that hold RECALL of the ``k`` nearest rows of ``sample`` of the held-out rows."""
    held, home, ranks = held[:PROBE_ROWS], nearest(sample, centres), []
    for s in range(0, len(held), 200):
        close, score = held[s : s + 200] @ sample.T, held[s : s + 200] @ centres.T
        best = np.argpartition(-close, min(k, len(sample)) - 1, axis=1)[:, :k]
        own = np.take_along_axis(score, home[best], axis=1)
        ranks += [(score > own[:, c : c + 1]).sum(axis=1) for c in range(own.shape[1])]
    return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1


def reach_of(floor: float, dim: int, exact: bool, deviations: float = DEVIATIONS) -> float:
    """How near to its border a cell is visited for pairs of cosine ``floor``; with a margin for rounding."""
    widest = math.sqrt((1 - floor) / 2)
    return (widest if exact else min(widest, deviations / 2 * math.sqrt((1 - floor * floor) / dim))) + 1e-5


def fit(df: DataFrame, record_id: str, vector: str, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, floor: float = 1.0, k: int = 5, dim: int = DIM, exact: bool = False, deviations: float = DEVIATIONS) -> Cells:
    """Centres over a bounded sample: ROWS_PER_CELL rows for each cell, from ``sample_rows`` to MOST_SAMPLE, drawn by a hash of the id.

    The reach is for pairs of cosine ``floor``, with ``exact`` proven; from -1 on, probes for ``k`` nearest. Where the most rows of a sample make too few cells, cells have more blocks.
    """
    n = df.count()
    cells = max(math.ceil(n / cell_rows), min(2 * df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))  # small tables have a cell for every core, too
    if cells < 2:
        return Cells(np.zeros((1, dim), np.float32), 0.0)
    parts = math.ceil(n / min(MOST_SAMPLE, max(sample_rows, ROWS_PER_CELL * cells)))
    drawn = df.where(F.pmod(F.xxhash64(record_id), F.lit(parts)) == 0).select(F.col(vector).cast("array<float>")).toArrow()
    x, _ = matrix(drawn.column(0), dim)
    if len(x) < 4:
        return Cells(np.zeros((1, dim), np.float32), 0.0)
    x = unit(x[distinct(x)[0]]).astype(np.float32)
    held = np.empty((0, dim), np.float32)
    if floor <= -1:  # probes are set on rows that the centres haven't seen, as most of the table's
        x, held = x[::2], x[1::2]
    centres = bisect(x, min(cells, max(1, len(x) // 4)))
    for _ in range(3):  # rows go to their nearest centre; nodes that are left without rows keep theirs
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    centres = np.ascontiguousarray(centres, dtype=np.float32)
    rows = np.bincount(nearest(x, centres), minlength=len(centres)) * (n / len(x))
    blocks = np.maximum(1, np.ceil(rows / (2 * cell_rows))).astype(np.int64)
    if floor <= -1:
        return Cells(centres, 0.0, probes_for(held, x, centres, k), blocks)
    return Cells(centres, reach_of(floor, dim, exact, deviations), 0, blocks)


def _routes(x: np.ndarray, cells: Cells, visits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and membership of every route of unit vectors."""
    home = nearest(x, cells.centres)
    if not visits or not cells.probes:
        return np.arange(len(x)), home, np.ones(len(x), bool)
    score = x @ cells.centres.T
    most = min(cells.probes, score.shape[1])
    goes = score >= -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
    goes[np.arange(len(x)), home] = True
    row, cell = np.nonzero(goes)
    return row, cell, cell == home[row]


def visited(x: np.ndarray, home: int, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every visit of unit rows of cell ``home`` to another cell."""
    rows, to, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], max(1, 16_000_000 // len(cells.centres))
    x = x.astype(np.float32)
    for s in range(0, len(x), step):
        part = x[s : s + step]
        goes = beyond(part @ cells.centres.T, np.full(len(part), home), cells.centres) <= cells.reach
        goes[:, home] = False
        r, c = np.nonzero(goes)
        rows.append(s + r)
        to.append(c)
    return np.concatenate(rows), np.concatenate(to)


def route(df: DataFrame, record_id: str, vector: str, cells: Cells, keep_ids: int, asks: Column | None = None) -> DataFrame:
    """ROUTED rows, each vector as a member of one block of its nearest cell. Rows for which ``asks`` holds also go to the cells that they probe.

    Rows of copies have a negative cell, ``id`` their representative and ``copy`` their own id.
    """
    schema = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("member", pa.bool_()), ("asks", pa.bool_()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.binary()), ("copy", pa.int64())])

    probing = asks is not None

    def chunk(ids: np.ndarray, x: np.ndarray, asking: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids, x, asking = ids[order], x[order], asking[order]
        first, which = distinct(x)
        rep = ids[first[which]]
        lists: dict[int, list[int]] = {}
        extra = np.flatnonzero(ids != rep)
        for i in extra:
            own = lists.setdefault(int(which[i]), [int(rep[i])])
            if len(own) < keep_ids and own[-1] != ids[i]:
                own.append(int(ids[i]))
        goes = np.zeros(len(first), bool)
        np.logical_or.at(goes, which, asking)
        for start in range(0, len(first), 8192):
            part = first[start : start + 8192]
            row, cell, member = _routes(unit(x[part]).astype(np.float32), cells, probing)
            block = (hashes(x[part])[row] % cells.blocks[cell].astype(np.uint64)).astype(np.int64)
            if not member.all():  # a visit is to all blocks of a cell
                on = np.flatnonzero(member | goes[start + row])
                times = np.where(goes[start + row[on]], cells.blocks[cell[on]], 1)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell, home = (np.repeat(a[on], times) for a in (row, cell, np.where(member, block, -1)))
                block = np.where(np.repeat(times, times) > 1, at, np.maximum(home, 0))
                member = home == block
            order = np.lexsort((block, cell))  # the rows of a cell leave together
            row, cell, block, member = row[order], cell[order], block[order], member[order]
            known = pa.array([lists.get(r) for r in (start + row).tolist()] if lists else [None] * len(row), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(cell.astype(np.int64)), pa.array(block.astype(np.int32)), pa.array(member), pa.array(goes[start + row]), pa.array(ids[part][row]), known, blobs(x[part][row]), pa.nulls(len(row), pa.int64())], schema=schema)
        if len(extra):
            n = len(extra)
            yield pa.record_batch([pa.array(-1 - ids[extra] % 997), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.array(rep[extra]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.array(ids[extra])], schema=schema)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            x, rows = matrix(b.column(1), cells.dim)
            ids = b.column(0).take(pa.array(rows)) if len(rows) else b.column(0).slice(0, 0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            asking = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)[rows]
            held.append((ids.drop_null().to_numpy(), x[known], asking[known]))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                yield from chunk(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from chunk(*map(np.concatenate, zip(*held, strict=True)))

    chosen = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"), (F.lit(True) if asks is None else asks).alias("asks"))
    return chosen.mapInArrow(run, ROUTED)


@dataclass
class Cell:
    """The distinct vectors of one block of a cell: as sent, as unit rows in doubles, whether members and asking; row and id of the ids of each and of its representatives."""

    raw: np.ndarray
    x: np.ndarray
    member: np.ndarray
    asks: np.ndarray
    ids: tuple[np.ndarray, np.ndarray]
    reps: tuple[np.ndarray, np.ndarray]


def per_row(row: np.ndarray, value: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, at most the first ``most`` of each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])][: len(row)]
    row, value = row[new], value[new]
    if most is not None and len(row):
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        row, value = row[place < most], value[place < most]
    return row, value


def read_cell(t: pa.Table, keep_ids: int, dim: int = DIM) -> Cell:
    """Put together what different chunks sent of one vector."""
    raw = np.frombuffer(joined(t["vec"]), np.float32).reshape(-1, dim)
    first, which = distinct(raw)
    rep = t["id"].to_numpy()
    member, asks = np.zeros(len(first), bool), np.zeros(len(first), bool)
    np.logical_or.at(member, which, t["member"].to_numpy())
    np.logical_or.at(asks, which, t["asks"].to_numpy())
    lists = t["ids"].combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = per_row(np.r_[which[size == 0], np.repeat(which, size)], np.r_[rep[size == 0], lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)], keep_ids)
    return Cell(raw[first], unit(raw[first]), member, asks, ids, per_row(which, rep))


def copies_of(t: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Representative and id of the rows of copies."""
    return t["id"].combine_chunks(), t["copy"].combine_chunks()
