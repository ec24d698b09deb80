"""Leaves of a bisecting k-means tree within the cells of ``cells``, and the pairs of leaves of different blocks that may hold similar vectors.

Within a block of a cell every node that isn't compact is split in two, all at once, level by level; as the splits end by compactness alone,
the order in which the loosest nodes come doesn't change the leaves. Neighbouring leaves that are compact together are put together again.

A leaf then visits each cell that one of its vectors visits, as its centre in bytes and the radius around just that centre. In a cell all visitors and the members of other blocks are
compared with all members by centre and radius, which proves most pairs of leaves linked or apart. What is left must be compared vector by vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as ce

#: Bits for a leaf's number within its block, and for a block's number within its cell.
LEAF_BITS, BLOCK_BITS = 24, 16
#: Rounds of putting leaves together.
MERGES = 6
#: Bits that mark leaves whose vectors are needed.
BITS = 1 << 26
#: A pair of leaves to be compared, with the centre and radius of the second.
FACING = "a bigint, b bigint, radius float, centre binary"
#: A visit: the cell, the slice of its visitors, whether leaf of the cell itself, the block that the leaves are of, and the leaves.
VISIT = "cell bigint, slice int, member boolean, own bigint, pack binary"


def record(dim: int, more: str) -> np.dtype:
    """A packed leaf: its number, radius and centre's direction; and ``part``, the least of the leaves it is linked with in its block, or ``need``, the least cosine of use to it."""
    return np.dtype([("leaf", "<u4"), (more, {"part": "<u4", "need": "<f2"}[more]), ("radius", "<f2"), ("centre", "u1", (-(-dim // 4) * 3,))])


def six_bits(centre: np.ndarray) -> np.ndarray:
    """Each element in six bits, four of them in three bytes; the largest of a row is 31."""
    n, dim = centre.shape
    v = np.full((n, -(-dim // 4) * 4), 32, np.uint32)
    v[:, :dim] = np.round(centre / np.maximum(np.abs(centre).max(axis=1, keepdims=True), 1e-12) * 31) + 32
    four = v.reshape(n, -1, 4)
    word = four[:, :, 0] | four[:, :, 1] << 6 | four[:, :, 2] << 12 | four[:, :, 3] << 18
    return np.stack([word & 255, word >> 8 & 255, word >> 16], axis=2).astype(np.uint8).reshape(n, -1)


def directions(raw: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors of ``six_bits``."""
    three = raw.reshape(len(raw), -1, 3).astype(np.uint32)
    word = three[:, :, 0] | three[:, :, 1] << 8 | three[:, :, 2] << 16
    c = (np.stack([word >> k & 63 for k in (0, 6, 12, 18)], axis=2).reshape(len(raw), -1)[:, :dim].astype(np.float64)) - 32
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def own_number(cell: int, block: int) -> int:
    return (cell << BLOCK_BITS) + block


def leaves(x: np.ndarray, limit: float) -> np.ndarray:
    """Leaf of each unit row: bisected until every row's cosine with its leaf's centre is at least ``limit``."""
    n = len(x)
    leaf = np.full(n, -1, np.int64)
    rows, node, made = np.arange(n), np.zeros(n, np.int64), 0
    while len(rows):
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[start, len(rows)])
        which = np.repeat(np.arange(len(start)), size)
        own = x[rows]
        centre = np.add.reduceat(own, start, axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        near = np.einsum("ij,ij->i", own, centre[which])
        compact = (np.minimum.reduceat(near, start) >= limit) | (size == 1)
        ended = compact[which]
        leaf[rows[ended]] = made + (np.cumsum(compact) - 1)[which[ended]]
        made += int(compact.sum())
        on = ~ended
        if not on.any():
            break
        rows, own, near, which = rows[on], own[on], near[on], which[on]
        start = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        size = np.diff(np.r_[start, len(rows)])
        which = np.repeat(np.arange(len(start)), size)
        first = np.lexsort((near, which))[start]  # the row farthest from the centre, and the one farthest from that
        second = np.lexsort((np.einsum("ij,ij->i", own, own[first][which]), which))[start]
        apart = own[first] - own[second]
        side = np.zeros(len(rows), bool)
        for k in range(3):
            now = np.einsum("ij,ij->i", own, apart[which]) > 0
            now[first], now[second] = (True, False) if k == 0 else (now[first], now[second])
            count = np.add.reduceat(now.astype(np.int64), start)
            bad = (count == 0) | (count == size)
            side = np.where(bad[which], side, now)
            if k == 2:
                break
            one = np.add.reduceat(np.where(side[:, None], own, 0), start, axis=0)
            two = np.add.reduceat(np.where(side[:, None], 0, own), start, axis=0)
            apart = one / np.maximum(np.linalg.norm(one, axis=1, keepdims=True), 1e-12) - two / np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-12)
        order = np.argsort(which * 2 + side, kind="stable")
        rows, node = rows[order], (which * 2 + side)[order]
    return leaf


def sums_of(x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The sum of the rows of each leaf."""
    if not len(x):
        return np.empty((0, x.shape[1]), x.dtype)
    order = np.argsort(leaf, kind="stable")
    return np.add.reduceat(x[order], np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]]), axis=0)


def put_together(x: np.ndarray, leaf: np.ndarray, limit: float) -> np.ndarray:
    """Leaves that are nearest to each other become one if it is compact, a few times over."""
    sums = sums_of(x, leaf)
    m = len(sums)
    label = np.arange(m)  # the leaf that each became
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    low, found, step = unit(sums).astype(np.float32), [np.empty((2, 0), np.int64)], max(1, 16_000_000 // max(1, m))
    for s in range(0, m, step):
        i, j = np.divmod(np.flatnonzero((low[s : s + step] @ low[s:].T > 2 * limit * limit - 1).ravel()), m - s)
        found.append(np.stack([i, j])[:, i < j] + s)
    pairs = np.concatenate(found, axis=1)
    for _ in range(MERGES):
        if not pairs.shape[1]:
            break
        centre = unit(sums)
        close = np.einsum("ij,ij->i", centre[pairs[0]], centre[pairs[1]])
        one, two = np.concatenate([pairs, pairs[::-1]], axis=1)
        order = np.lexsort((two, -np.r_[close, close], one))
        first = order[np.r_[True, one[order][1:] != one[order][:-1]]]
        near = np.full(m, -1)
        near[one[first]] = two[first]
        a = np.flatnonzero((near > np.arange(m)) & (near[near] == np.arange(m)))
        new = np.arange(m)
        new[near[a]] = a
        both = sums.copy()
        both[a] += sums[near[a]]
        at = new[label][leaf]
        least = np.full(m, 2.0)
        np.minimum.at(least, at, np.einsum("ij,ij->i", x, unit(both)[at]))
        good = least[a] >= limit
        lost = np.zeros(m, bool)  # pairs that failed stay apart
        lost[a[~good]] = True
        a = a[good]
        new = np.arange(m)
        new[near[a]] = a
        label = new[label]
        sums[a] += sums[near[a]]
        failed = lost[pairs[0]] & (near[pairs[0]] == pairs[1])
        pairs = np.sort(new[pairs[:, ~failed]], axis=0)
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
    return np.unique(label[leaf], return_inverse=True)[1].ravel()


def angle_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle of each row of x with that of y, exact for small ones."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1))


def compact(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each unit row, and the unit centre and the radius of each leaf, any two of whose rows have a cosine of at least ``least``."""
    limit = float(np.cos(np.arccos(least) / 2)) + 1e-5
    leaf = put_together(x, leaves(x.astype(np.float32), limit), limit)
    centre = sums_of(x, leaf)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    radius = np.zeros(len(centre))
    np.maximum.at(radius, leaf, angle_of(x, centre[leaf]))
    return leaf, centre, radius


def packed(x: np.ndarray, leaf: np.ndarray, centre: np.ndarray, **more: np.ndarray) -> np.ndarray:
    """The record of each leaf; its radius is around the centre as the record has it."""
    ((name, value),) = more.items()
    out = np.zeros(len(centre), record(x.shape[1], name))
    out["leaf"], out[name] = np.arange(len(centre)), value if name == "part" else value - 1e-3  # halves of so many bits round up by less
    out["centre"] = six_bits(centre)
    radius = np.zeros(len(centre))
    np.maximum.at(radius, leaf, angle_of(x, directions(out["centre"], x.shape[1])[leaf]))
    out["radius"] = radius * 1.001 + 1e-6
    return out


def visits(x: np.ndarray, leaf: np.ndarray, pack: np.ndarray, cell: int, block: int, cells: ce.Cells) -> dict[str, pa.Array]:
    """The columns of VISIT: the leaves as members of their cell, in each slice, and as visitors of others."""
    own = own_number(cell, block)
    row, to = ce.visited(x, cell, cells)
    pairs = np.unique(to * len(pack) + leaf[row]) if len(row) else np.empty(0, np.int64)
    to, which = np.divmod(pairs, max(1, len(pack)))
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
    out = [(cell, s, True, pack.tobytes()) for s in range(int(cells.blocks[cell]))]
    out += [(int(to[s]), (own * 2_654_435_761 >> 20) % int(cells.blocks[to[s]]), False, pack[which[s:e]].tobytes()) for s, e in zip(cut, np.r_[cut[1:], len(to)][: len(cut)], strict=True)]
    dest, part, member, raw = zip(*out, strict=True)
    return {"cell": pa.array(dest, pa.int64()), "slice": pa.array(part, pa.int32()), "member": pa.array(member), "own": pa.array([own] * len(out), pa.int64()), "pack": pa.array(raw, pa.binary())}


def meet(t: pa.Table, least: float, cells: ce.Cells, more: str, emit: Callable) -> None:
    """Give ``emit`` the pairs of leaves of one slice of a cell that radii don't prove apart: packs and blocks of visitors and members, rows of both, their angle and radii."""
    kind = record(cells.dim, more)
    number = t["slice"][0].as_py()
    packs = [np.frombuffer(raw, kind) for raw in t["pack"].to_pylist()]
    sizes, owns, member = [len(p) for p in packs], t["own"].to_numpy(), t["member"].to_numpy(zero_copy_only=False)
    all_, own, inside = np.concatenate(packs), np.repeat(owns, sizes), np.repeat(member, sizes)
    asking = np.flatnonzero(~inside | (own % (1 << BLOCK_BITS) == number))
    asked = np.flatnonzero(inside)
    asking, asked = (k[np.argsort(all_["radius"][k], kind="stable")] for k in (asking, asked))
    a, b, oa, ob = all_[asking], all_[asked], own[asking], own[asked]
    ca, cb = (directions(v["centre"], cells.dim) for v in (a, b))
    la, lb, ra, rb = ca.astype(np.float32), cb.astype(np.float32), a["radius"].astype(np.float64), b["radius"].astype(np.float64)
    angle = float(np.arccos(least))
    for s in range(0, len(a), 512):  # pieces that stay in the processor's cache
        for u in range(0, len(b), 2048):
            reach = np.cos(np.minimum(angle + ra[s : s + 512] + rb[u : u + 2048][-1] + 1e-6, np.pi)) - 1e-5
            near = np.flatnonzero((la[s : s + 512] @ lb[u : u + 2048].T >= reach[:, None].astype(np.float32)).ravel())
            i, j = np.divmod(near, len(lb[u : u + 2048]))
            i, j = i + s, j + u
            on = oa[i] != ob[j]
            i, j = i[on], j[on]
            apart = angle_of(ca[i], cb[j])
            on = apart <= angle + ra[i] + rb[j] + 1e-6
            if on.any():
                emit(a, b, oa, ob, i[on], j[on], apart[on], (ra[i] + rb[j])[on])


def roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component after adding the edges a-b."""
    while True:
        one, two = parent[a], parent[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def number(own: np.ndarray, local: np.ndarray) -> np.ndarray:
    """The number of a leaf in the whole table."""
    return (own << LEAF_BITS) + local.astype(np.int64)


def _facing(a, b, oa, ob, i, j) -> dict[str, np.ndarray]:
    """Pairs of leaves, the one of larger radius as ``a``, with the centre and radius of the other: the vectors of ``a`` too far from it needn't be sent."""
    one, two = number(oa[i], a["leaf"][i]), number(ob[j], b["leaf"][j])
    ra, rb = a["radius"][i], b["radius"][j]
    turn = (rb > ra) | ((rb == ra) & (two > one))
    centre = np.where(turn[:, None], a["centre"][i], b["centre"][j])
    return {"a": np.where(turn, two, one), "b": np.where(turn, one, two), "radius": np.where(turn, ra, rb).astype(np.float32), "centre": centre}


def _tabled(found: list[dict[str, np.ndarray]], dim: int, **ends: np.ndarray) -> pa.Table:
    empty = {"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "radius": np.empty(0, np.float32), "centre": np.empty((0, -(-dim // 4) * 3), np.uint8)}
    whole = {k: np.concatenate([v, *(f[k] for f in found)]) for k, v in empty.items()}
    return pa.table({k: pa.array(v) for k, v in ends.items()} | {k: ce.blobs(v) if k == "centre" else pa.array(v) for k, v in whole.items()})


def sure_and_open(t: pa.Table, least: float, cells: ce.Cells) -> pa.Table:
    """u, v and FACING: linked parts u and v, as a forest, with null leaves; and leaves of parts not linked so, that must be compared."""
    angle = float(np.arccos(least))
    sure: list[np.ndarray] = [np.empty((2, 0), np.int64)]
    open_: list[np.ndarray] = [np.empty((2, 0), np.int64)]
    pairs: list[dict[str, np.ndarray]] = []

    def emit(a, b, oa, ob, i, j, apart, both):
        certain = apart + both <= angle - 1e-6
        ends = np.stack([number(oa[i], a["part"][i]), number(ob[j], b["part"][j])])
        sure.append(np.unique(ends[:, certain], axis=1))
        open_.append(ends[:, ~certain])
        pairs.append(_facing(a, b, oa, ob, i[~certain], j[~certain]))

    meet(t, least, cells, "part", emit)
    sure_, rest = (np.concatenate(c, axis=1) for c in (sure, open_))
    names, at = np.unique(np.r_[sure_.ravel(), rest.ravel()], return_inverse=True)
    parent = roots(np.arange(len(names)), *at[: sure_.size].reshape(2, -1))
    linked = np.flatnonzero(parent != np.arange(len(names)))
    x, y = at[sure_.size :].reshape(2, -1)
    on, done = parent[x] != parent[y], 0
    for f in pairs:
        n = len(f["a"])
        f.update({k: v[on[done : done + n]] for k, v in f.items()})
        done += n
    left = _tabled(pairs, cells.dim, u=rest[0][on], v=rest[1][on])
    forest = pa.table({"u": names[parent[linked]], "v": names[linked]} | {k: pa.nulls(len(linked), left.schema.field(k).type) for k in ("a", "b", "radius", "centre")})
    return pa.concat_tables([forest, left])


def useful(t: pa.Table, least: float, cells: ce.Cells) -> pa.Table:
    """FACING: leaves of which one may hold a vector that a vector of the other has use for."""
    found: list[dict[str, np.ndarray]] = []

    def emit(a, b, oa, ob, i, j, apart, both):
        on = np.cos(np.maximum(apart - both - 1e-6, 0)) + 1e-6 >= np.minimum(a["need"][i], b["need"][j]).astype(np.float64)
        found.append(_facing(a, b, oa, ob, i[on], j[on]))

    meet(t, least, cells, "need", emit)
    return _tabled(found, cells.dim)


def facing(raw: np.ndarray, centre: bytes, radius: float, least: float) -> np.ndarray:
    """The rows that may have a cosine of ``least`` with a vector of the leaf of that centre and radius."""
    c = directions(np.frombuffer(centre, np.uint8)[None], raw.shape[1])
    return np.flatnonzero(angle_of(ce.unit(raw), c) <= np.arccos(least) + radius + 1e-6)


def needed(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those leaves of ``kept`` that ``pairs`` names, and few others: a bitmap of at most BITS bits drops most of the rest before the shuffle."""
    bit = F.pmod(F.xxhash64("leaf"), F.lit(BITS))
    named = pairs.select(bit.alias("bit"))
    marks = named.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # bounded by BITS
    bits = {r["bucket"]: bytes(r["bits"]) for r in marks}
    none = bytes(1 << 12)

    def run(batches):
        for batch in batches:
            on = [bits.get(b, none)[p >> 3] >> (p & 7) & 1 == 1 for b, p in zip(batch["bucket"].to_pylist(), batch["place"].to_pylist(), strict=True)]
            yield batch.drop_columns(["bucket", "place"]).filter(pa.array(on, pa.bool_()))

    asked = kept.withColumn("bit", bit).select(*kept.columns, F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    return asked.mapInArrow(run, kept.schema)
