"""The k most similar vectors of every vector, by an adaptive dimension scan of probed lists.

The lists are the blocks of the cells of ``cells``. Vectors are turned at random and stored in blocks
of columns. After each block the partial squared distance, scaled to all dimensions, is tested against the bound of the query, its k-th best
so far or the least similarity asked for: a candidate whose estimate exceeds it by more than chance allows is abandoned. What is left is compared exactly, in
doubles rounded to nine decimals. A pair found from either side counts for both.

With a floor, a vector scans its own list; then compact leaves of neighbouring vectors, not single ones, probe the other lists (``leaves``), and the vectors of two leaves are scanned against each other
unless the leaves' radii prove that no pair of theirs reaches the floor or the k-th best so far. Without a floor, or for single queries, the queries themselves go to the lists they probe.

Defined cases: vectors that are null, of another length, with an element that is null or not finite, or all zero are left out, as are null ids.
Copies under other ids are neighbours of each other at cosine 1. Ties go to the smaller id. Rows of one id count once. Other columns are
never read. Empty input yields no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stored
from . import cells as ce
from . import leaves as lv

#: Columns of a block, after each of which a candidate is tested, and how many standard errors of chance it is given. Where over WASTE of the
#: candidates of a first piece outlast the first block, the next one is joined to it.
BLOCK, CHANCE, WASTE = 16, 3.0, 0.02
#: See ``cells``; losing a pair costs less here than among linked clusters.
DEVIATIONS, CELL_ROWS = 3.5, 56_000
#: Queries that are compared with all rows in one pass, when recall is measured.
QUERY_BLOCK = 20_000
QUERY_ROWS, LIST_ROWS = 1024, 2048
SCALE = 1_000_000_000
FOUND = "rep bigint, far array<int>, near array<bigint>, copy bigint"
#: FOUND, or a leaf with its vectors and their names (one id of each; or numbers of ids and representatives of each, ids, representatives), or a visit of ``leaves``.
ROWS = f"{FOUND}, leaf bigint, vecs binary, names binary, {lv.VISIT}"


@lru_cache(maxsize=8)
def rotation(dim: int = ce.DIM, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def best_of(key: np.ndarray, cos: np.ndarray, tie: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of each key, each (key, other) once, in order."""
    order = np.lexsort((other, tie, -cos, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (other[order][1:] == other[order][:-1])
    order = order[~same]
    sorted_key = key[order]
    start = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]][: len(order)])
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < k]


def allowance(columns: int, dim: int) -> float:
    """The share of a squared distance that the first ``columns`` of a vector near enough may show."""
    return min(1.0, (1 + CHANCE / np.sqrt(columns)) ** 2 * columns / dim) if columns < dim else 1.0


def first_blocks(x: np.ndarray, queries: np.ndarray, members: np.ndarray, bound: float) -> list[int]:
    """The columns after which candidates are tested."""
    dim = x.shape[1]
    ends = [*range(BLOCK, dim, BLOCK), dim]
    q, m = x[queries[:256]], x[members[:1024]]
    while len(ends) > 1:
        d = ends[0]
        apart = (q[:, :d] ** 2).sum(axis=1)[:, None] + (m[:, :d] ** 2).sum(axis=1) - 2 * q[:, :d] @ m[:, :d].T
        if (apart <= bound * allowance(d, dim)).mean() <= WASTE:
            break
        ends = ends[1:]
    return ends


def scan(x: np.ndarray, queries: np.ndarray, members: np.ndarray, tie: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and rounded cosine of the ``k`` best of each row, as far as the scan of ``queries`` against ``members`` finds them.

    ``x`` has unit rows. ``tie`` orders equal ones. The row itself is among its own. Where the queries are the members, each pair is looked at from one side.
    """
    dim = x.shape[1]
    half = np.array_equal(queries, members)
    limit = np.full(len(x) if half else 0, 2 - 2 * floor + 2e-6, np.float32)
    turned = x @ rotation(dim)
    whole, wide = turned.astype(np.float32), 2 - 2 * floor > 1
    ends = first_blocks(whole, queries, members, 2 - 2 * floor) if not wide else [dim]
    parts = [np.ascontiguousarray(whole[:, a:b]) for a, b in zip((0, *ends), ends)]
    squares = (parts[0] ** 2).sum(axis=1)
    give = [allowance(d, dim) for d in ends]
    targets = np.concatenate([-2 * parts[0], np.ones((len(x), 1), np.float32), squares[:, None]], axis=1)
    out: list[tuple[np.ndarray, ...]] = []
    back = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for a in range(0, len(queries), QUERY_ROWS):
        q = queries[a : a + QUERY_ROWS]
        head = np.concatenate([parts[0][q], squares[q][:, None], np.ones((len(q), 1), np.float32)], axis=1)
        bound = np.full(len(q), 2 - 2 * floor + 2e-6, np.float32)
        have = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in range(a if half and not wide else 0, len(members), LIST_ROWS):
            m = members[b : b + LIST_ROWS]
            if wide:  # no block of columns tells much: all columns, and the best of the first list give the first bound
                close = whole[q] @ whole[m].T
                if b == 0:
                    take = min(k, len(m))
                    j = np.argpartition(-close, take - 1, axis=1)[:, :take].ravel()
                    i = np.repeat(np.arange(len(q)), take)
                else:
                    i, j = np.nonzero(close >= (1 - bound / 2 - 2e-5)[:, None])
            else:
                i, j = np.divmod(np.flatnonzero((head @ targets[m].T <= ((limit[q] if half else bound) * give[0])[:, None]).ravel()), len(m))
                gone = ((parts[0][q[i]] - parts[0][m[j]]) ** 2).sum(axis=1) if len(i) else np.empty(0, np.float32)
                for part, share in zip(parts[1:], give[1:], strict=True):
                    gone = gone + ((part[q[i]] - part[m[j]]) ** 2).sum(axis=1)
                    on = gone <= (np.maximum(bound[i], limit[m[j]]) if half else bound[i]) * share + 2e-5
                    i, j, gone = i[on], j[on], gone[on]
            if not len(i):
                continue
            cos = np.round(np.concatenate([np.einsum("ij,ij->i", x[q[i[s : s + 65536]]], x[m[j[s : s + 65536]]]) for s in range(0, len(i), 65536)]), 9)
            on = cos >= floor
            i, other, cos = i[on], m[j[on]], cos[on]
            have = tuple(map(np.concatenate, zip(have, (i, other, cos), strict=True)))
            keep = best_of(have[0], have[2], tie[have[1]], have[1], k)
            have = tuple(h[keep] for h in have)
            full = np.flatnonzero(np.bincount(have[0], minlength=len(q)) >= k)
            if len(full):
                last = np.r_[have[0][1:] != have[0][:-1], True]
                worst = np.full(len(q), np.inf)
                worst[have[0][last]] = 2 - 2 * have[2][last]
                bound[full] = np.minimum(bound[full], worst[full] + 2e-6)
            back = tuple(map(np.concatenate, zip(back, (other, q[i], cos), strict=True)))
            if len(back[0]) > 2_000_000:
                keep = best_of(back[0], back[2], tie[back[1]], back[1], k)
                back = tuple(h[keep] for h in back)
        out.append((q[have[0]], have[1], have[2]))
    row, other, cos = map(np.concatenate, zip(*out, back, strict=True)) if out else back
    keep = best_of(row, cos, tie[other], other, k)
    return row[keep], other[keep], cos[keep]


def _best_ids(ids: tuple[np.ndarray, np.ndarray], row: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and cosine of the ``k`` best ids of each row; ``ids`` has the rows and ids of all, in order of rows."""
    n = int(max(row.max(initial=-1), other.max(initial=-1), ids[0].max(initial=-1))) + 1
    sizes = np.bincount(ids[0], minlength=n)
    start = np.cumsum(sizes) - sizes
    times = sizes[other]
    row, cos = np.repeat(row, times), np.repeat(cos, times)
    near = ids[1][np.repeat(start[other] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    keep = best_of(row, cos, near, near, k)
    return row[keep], near[keep], cos[keep]


def _lists(reps: tuple[np.ndarray, np.ndarray], row: np.ndarray, near: np.ndarray, cos: np.ndarray) -> dict[str, pa.Array]:
    """rep, far, near of each representative of the rows, which are in order, with all their entries."""
    n = int(max(row.max(initial=-1), reps[0].max(initial=-1))) + 1
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    of, rep = (v[count[reps[0]] > 0] for v in reps)
    size = count[of]
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[of], size)
    offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
    far = np.round((1 - cos) * SCALE).astype(np.int32)
    return {"rep": pa.array(rep, pa.int64()), "far": pa.ListArray.from_arrays(offsets, pa.array(far[take], pa.int32())), "near": pa.ListArray.from_arrays(offsets, pa.array(near[take], pa.int64()))}


def scan_block(cell: ce.Cell, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and cosine of the ``k`` best ids of each asking row of a block, itself among them."""
    own = np.arange(len(cell.x))
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, *cell.ids)
    row, other, cos = scan(cell.x, np.flatnonzero(cell.asks), np.flatnonzero(cell.member), least, k, floor)
    return _best_ids(cell.ids, np.r_[row, own], np.r_[other, own], np.r_[cos, np.ones(len(own))], k)


def _without_self(cell: ce.Cell, row: np.ndarray, near: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries without the row itself where it has one id only; copies need their common list whole."""
    alone = np.bincount(cell.ids[0], minlength=len(cell.x)) == 1
    first = np.full(len(cell.x), -1, np.int64)
    first[cell.ids[0]] = cell.ids[1]
    on = ~(alone[row] & (near == first[row]))
    return row[on], near[on], cos[on]


def _lists_of(found: DataFrame, keep: int) -> DataFrame:
    """id, best: the ``keep`` best of each id, from the lists and copies of FOUND. An id delivered in several chunks may come more than once, alike."""
    some = F.collect_list(F.when(F.size("near") > 0, F.struct("far", "near")))  # two flat arrays travel, not structs
    lists = found.groupBy("rep").agg(F.transform(some, lambda x: F.arrays_zip(x["far"].alias("far"), x["near"].alias("near"))).alias("lists"), F.collect_set("copy").alias("copies"))
    return lists.select(F.explode(F.array_union(F.array("rep"), "copies")).alias("id"), F.slice(F.array_sort(F.array_distinct(F.flatten("lists"))), 1, keep).alias("best"))


def _others(lists: DataFrame, k: int) -> DataFrame:
    return lists.select("id", F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k).alias("best"))


def _columns(n: int, **columns) -> pa.Table:
    names = {"rep": pa.int64(), "far": pa.list_(pa.int32()), "near": pa.list_(pa.int64()), "copy": pa.int64(), "leaf": pa.int64(), "vecs": pa.binary(), "names": pa.binary(), "cell": pa.int64(), "slice": pa.int32(), "member": pa.bool_(), "own": pa.int64(), "pack": pa.binary()}
    return pa.table({c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in names.items()}, schema=pa.schema(list(names.items())))


def _named(leaf: np.ndarray, ids: tuple[np.ndarray, np.ndarray], reps: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The names of each leaf's rows, rows in order of leaf."""
    order = np.argsort(leaf, kind="stable")
    place = np.empty(len(leaf), np.int64)
    place[order] = np.arange(len(leaf))
    sizes = np.cumsum(np.bincount(leaf))
    parts = []
    for row, value in (ids, reps):
        by = np.argsort(place[row], kind="stable")
        count = np.bincount(row, minlength=len(leaf))[order]
        parts.append((np.split(count, sizes[:-1]), np.split(value[by], np.cumsum(np.add.reduceat(count, np.r_[0, sizes[:-1]]))[:-1])))
    whole = lambda a, b, c, d: c if len(c) == len(d) == len(a) and (c == d).all() else np.concatenate([a, b, c, d])
    return [whole(a, b, c, d).astype("<i8").tobytes() for a, b, c, d in zip(parts[0][0], parts[1][0], parts[0][1], parts[1][1], strict=True)]


def _names(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and id of the ids, and of the representatives, of a leaf of ``rows`` vectors."""
    v = np.frombuffer(raw, "<i8")
    if len(v) == rows:  # each vector has one id, its own representative
        return np.arange(rows), v, np.arange(rows), v
    a, b = v[:rows], v[rows : 2 * rows]
    return np.repeat(np.arange(rows), a), v[2 * rows : 2 * rows + a.sum()], np.repeat(np.arange(rows), b), v[2 * rows + a.sum() :]


def _facing(batches, floor: float, dim: int):
    """The vectors of the first leaf of each pair, with their names, that may reach the floor with one of the other."""
    for batch in batches:
        vecs, names = [], []
        for raw, own, centre, radius in zip(*(batch[c].to_pylist() for c in ("vecs", "names", "centre", "radius")), strict=True):
            x = np.frombuffer(raw, np.float32).reshape(-1, dim)
            on = lv.facing(x, centre, radius, floor)
            i, ids, r, reps = _names(own, len(x))
            new = np.full(len(x), -1)
            new[on] = np.arange(len(on))
            a, b = new[i] >= 0, new[r] >= 0
            vecs.append(x[on].tobytes() or None)
            names.append(_named(np.zeros(len(on), np.int64), (new[i][a], ids[a]), (new[r][b], reps[b]))[0] if len(on) else None)
        made = pa.array(vecs, pa.binary())
        yield pa.record_batch([batch["b"], made, pa.array(names, pa.binary())], names=["leaf", "near_vecs", "near_names"]).filter(made.is_valid())


def scan_pairs(x: np.ndarray, p: np.ndarray, q: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows of at least ``floor``, with their rounded cosines; the scan of ``scan`` over single pairs."""
    dim, bound = x.shape[1], 2 - 2 * floor + 2e-6
    whole = (x @ rotation(dim)).astype(np.float32)
    gone = np.zeros(len(p), np.float32)
    for d in range(0, dim, BLOCK):
        gone = gone + ((whole[p, d : d + BLOCK] - whole[q, d : d + BLOCK]) ** 2).sum(axis=1)
        on = gone <= bound * allowance(min(d + BLOCK, dim), dim) + 2e-5
        p, q, gone = p[on], q[on], gone[on]
    cos = np.round(np.einsum("ij,ij->i", x[p], x[q]), 9)
    on = cos >= floor
    return p[on], q[on], cos[on]


def _scan_leaves(batches, keep: int, floor: float, dim: int):
    """FOUND rows of the vectors of two leaves against each other."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("near_vecs", "vecs", "near_names", "names")]
        start = 0
        while start < len(columns[0]):
            raw, ids, reps, p, q, n, pairs = [], ([], []), ([], []), [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
            found = []
            while start < len(columns[0]) and pairs < 1_000_000:
                v1, v2, n1, n2 = (c[start] for c in columns)
                m1, m2 = len(v1) // (4 * dim), len(v2) // (4 * dim)
                for at, names in ((n, _names(n1, m1)), (n + m1, _names(n2, m2))):
                    ids[0].append(names[0] + at)
                    ids[1].append(names[1])
                    reps[0].append(names[2] + at)
                    reps[1].append(names[3])
                raw += [v1, v2]
                if m1 * m2 <= 1_000_000:
                    p.append(n + np.repeat(np.arange(m1), m2))
                    q.append(n + m1 + np.tile(np.arange(m2), m1))
                else:
                    found.append((n, n + m1, n + m1 + m2))
                n, pairs, start = n + m1 + m2, pairs + m1 * m2, start + 1
            x = ce.unit(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim))
            own_ids, own_reps = (tuple(map(np.concatenate, v)) for v in (ids, reps))
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, *own_ids)
            a, b, cos = scan_pairs(x, np.concatenate(p), np.concatenate(q), floor)
            hits = [(a, b, cos), (b, a, cos)] + [scan(x, np.arange(s, m), np.arange(m, e), least, keep, floor) for s, m, e in found]
            row, other, cos = map(np.concatenate, zip(*hits, strict=True))
            if len(row):
                lists = _lists(own_reps, *_best_ids(own_ids, row, other, cos, keep))
                yield from _columns(len(lists["rep"]), **lists).select(["rep", "far", "near", "copy"]).combine_chunks().to_batches()


def _by_leaves(df: DataFrame, record_id: str, vector: str, k: int, floor: float, cells: ce.Cells) -> DataFrame:
    """FOUND rows over the whole table."""
    keep = k + 1  # a row is among its own neighbours until the end
    many = len(cells.centres) > 1 or cells.blocks[0] > 1

    def run(key, t):
        if key[0].as_py() < 0:
            rep, copy = ce.copies_of(t)
            return _columns(len(rep), rep=rep, copy=copy)
        at, block = key[0].as_py(), key[1].as_py()
        cell = ce.read_cell(t, keep, cells.dim)
        row, near, cos = scan_block(cell, keep, floor)
        lists = _lists(cell.reps, *_without_self(cell, row, near, cos))
        out = [_columns(len(lists["rep"]), **lists)]
        if many:
            count, last = np.bincount(row, minlength=len(cell.x)), np.r_[row[1:] != row[:-1], True]
            need = np.full(len(cell.x), floor)
            need[row[last & (count[row] >= keep)]] = cos[last & (count[row] >= keep)]
            leaf, centre, _ = lv.compact(cell.x, floor)
            least = np.full(len(centre), 1.0)
            np.minimum.at(least, leaf, need - 1e-6)
            order = np.argsort(leaf, kind="stable")
            raw = [r.tobytes() for r in np.split(cell.raw[order], np.cumsum(np.bincount(leaf))[:-1])]
            own = lv.own_number(at, block) << lv.LEAF_BITS
            out.append(_columns(len(raw), leaf=pa.array(own + np.arange(len(raw))), vecs=pa.array(raw, pa.binary()), names=pa.array(_named(leaf, cell.ids, cell.reps), pa.binary())))
            sent = lv.visits(cell.x, leaf, lv.packed(cell.x, leaf, centre, need=least), at, block, cells)
            out.append(_columns(len(sent["cell"]), **sent))
        return pa.concat_tables(out)

    grown = ce.route(df, record_id, vector, cells, keep).groupBy("cell", "block").applyInArrow(run, ROWS)
    if not many:
        return grown.where("rep is not null").select("rep", "far", "near", "copy")
    grown = stored(grown)
    sent = grown.where("pack is not null").select("cell", "slice", "member", "own", "pack")
    pairs = cut_lineage(sent.groupBy("cell", "slice").applyInArrow(lambda t: lv.useful(t, floor, cells), lv.FACING))
    kept, asked = grown.where("vecs is not null").select("leaf", "vecs", "names"), pairs.dropDuplicates(["a", "b"]).withColumnRenamed("a", "leaf")
    sides = asked.join(lv.needed(kept, pairs.select(F.col("a").alias("leaf"))), "leaf").select("b", "vecs", "names", "centre", "radius")
    sides = cut_lineage(sides.mapInArrow(lambda t: _facing(t, floor, cells.dim), "leaf bigint, near_vecs binary, near_names binary"))
    scanned = sides.join(lv.needed(kept, sides.select("leaf")), "leaf").select("near_vecs", "vecs", "near_names", "names").mapInArrow(lambda b: _scan_leaves(b, keep, floor, cells.dim), FOUND)
    return grown.where("rep is not null").select("rep", "far", "near", "copy").union(scanned)


def _by_probes(df: DataFrame, record_id: str, vector: str, k: int, floor: float, queries: Callable[[Column], Column] | None, cells: ce.Cells) -> DataFrame:
    """FOUND rows of the queries, which go to the lists themselves."""
    keep = k + 1
    asks = F.lit(True) if queries is None else queries(F.col(record_id))

    def run(key, t):
        if key[0].as_py() < 0:
            rep, copy = ce.copies_of(t)
            return _columns(len(rep), rep=rep, copy=copy).select(["rep", "far", "near", "copy"])
        cell = ce.read_cell(t, keep, cells.dim)
        row, near, cos = scan_block(cell, keep, floor)
        some = cell.asks[row]
        lists = _lists(cell.reps, *_without_self(cell, row[some], near[some], cos[some]))
        return _columns(len(lists["rep"]), **lists).select(["rep", "far", "near", "copy"])

    return ce.route(df, record_id, vector, cells, keep, asks).groupBy("cell", "block").applyInArrow(run, FOUND)


def neighbours(df: DataFrame, record_id: str, vector: str, k: int = 5, floor: float = -1.0, queries: Callable[[Column], Column] | None = None, cells: ce.Cells | None = None, **fitted) -> DataFrame:
    """id, near_id, place, cosine: the ``k`` most similar vectors of each, of at least ``floor``.

    With ``queries``, a condition on the id, only those rows are queries, against all. ``fitted``: arguments of ``cells.fit``.
    """
    lists = _lists_of(_found(df, record_id, vector, k, floor, queries, cells, fitted), k + 1)
    if queries:
        lists = lists.where(queries(F.col("id")))
    own = lists.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
    return _others(own, k).select("id", F.posexplode("best").alias("place", "x")).select("id", F.col("x.near").alias("near_id"), (F.col("place") + 1).alias("place"), (1 - F.col("x.far") / SCALE).alias("cosine"))


def _found(df: DataFrame, record_id: str, vector: str, k: int, floor: float, queries: Callable[[Column], Column] | None, cells: ce.Cells | None, fitted: dict) -> DataFrame:
    cells = cells or ce.fit(df, record_id, vector, **{"floor": floor if queries is None else -1.0, "k": k, "deviations": DEVIATIONS, "cell_rows": CELL_ROWS if floor > -1 else ce.CELL_ROWS} | fitted)
    return _by_leaves(df, record_id, vector, k, floor, cells) if floor > -1 and queries is None else _by_probes(df, record_id, vector, k, floor, queries, cells)


def similar_pairs(df: DataFrame, record_id: str, vector: str, k: int = 5, floor: float = -1.0, cells: ce.Cells | None = None, **fitted) -> DataFrame:
    """a < b of which one is among the ``k`` most similar of the other, once."""
    pairs = _others(_lists_of(_found(df, record_id, vector, k, floor, None, cells, fitted), k + 1), k).select("id", F.explode("best.near").alias("near"))
    return pairs.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()


def exact_nearest(df: DataFrame, record_id: str, vector: str, queries: Callable[[Column], Column], k: int = 5, floor: float = -1.0, dim: int = ce.DIM, block: int = QUERY_BLOCK) -> DataFrame:
    """id, near_id, cosine: what ``neighbours`` should find, by comparing each query with every row; to measure recall.

    The queries go in blocks of ``block``, whose size bounds what each task is given; a block is one pass over the table, in which every task keeps its ``k`` best of each query.
    """
    rows = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    asked = rows.where(queries(F.col("id")))
    blocks = max(1, -(-asked.count() // block))

    def valid(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, at = ce.matrix(t["vector"], dim)
        ids = t["id"].take(pa.array(at)) if len(at) else t["id"].slice(0, 0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return x[known], ids.drop_null().to_numpy()

    def against(x: np.ndarray, ids: np.ndarray):
        q = ce.unit(x) if len(x) else x.astype(np.float64)
        low = q.astype(np.float32)

        def run(batches):
            have = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for batch in batches:
                y, other = valid(batch)
                if not len(y) or not len(q):
                    continue
                u = ce.unit(y)
                take, narrow, hits = min(k + 3, len(u)), u.astype(np.float32).T, []  # a few more than k, as these are cosines of little precision
                for s in range(0, len(q), QUERY_ROWS):
                    close = low[s : s + QUERY_ROWS] @ narrow
                    close[ids[s : s + QUERY_ROWS, None] == other] = -9
                    j = np.argpartition(-close, take - 1, axis=1)[:, :take].ravel()
                    i = np.repeat(np.arange(len(close)), take)
                    on = close[i, j] >= max(floor, -1) - 1e-5
                    hits.append((i[on] + s, j[on]))
                i, j = map(np.concatenate, zip(*hits, strict=True))
                cos = np.round(np.einsum("ij,ij->i", q[i], u[j]), 9)
                have = tuple(map(np.concatenate, zip(have, (i, other[j], cos), strict=True)))
                keep = best_of(have[0], have[2], have[1], have[1], k)
                have = tuple(h[keep] for h in have)
            on = have[2] >= floor
            yield pa.record_batch([pa.array(ids[have[0]][on]), pa.array(have[1][on]), pa.array(have[2][on])], names=["id", "near_id", "cosine"])

        return run

    parts = []
    for b in range(blocks):
        x, ids = valid(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).dropDuplicates(["id"]).toArrow())
        parts.append(rows.mapInArrow(against(x, ids), "id bigint, near_id bigint, cosine double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), "near_id"))), 1, k)  # at most k of each task
    return found.groupBy("id").agg(best.alias("best")).select("id", F.explode("best").alias("x")).select("id", "x.near_id", (-F.col("x.d")).alias("cosine"))
