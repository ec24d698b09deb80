"""Clusters of mutually similar vectors over the whole table, by bisecting k-means.

The tree starts with the cells of ``cells``, fitted on a sample by splitting the node of largest dispersion, and goes on within each block of a cell over all its rows until a leaf is compact: all
its vectors lie so near its centre that any two of them are linked. Leaves of a block are linked certainly if centres and radii
prove it, not at all if they exclude it, and else by comparing their vectors exactly; leaves of different blocks in the same way, where one visits the other's cell
(``leaves``). The blocks' clusters are joined over the table by large-star and small-star rounds.

With ``exact`` the visits provably reach every link; without it they miss one at the very threshold with a chance of about one in a million (DEVIATIONS in ``cells``).

Defined cases: vectors that are null, of another length, with an element that is null or not finite, or all zero are left out, as are null ids.
Copies under other ids are one cluster. Rows of one id count once. Other columns are never read. Empty input yields no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut_lineage, stored
from . import cells as ce
from . import leaves as lv

#: A row of a vector with its leaf, part and cosine with the leaf's centre; of a copy; of a leaf with its vectors; or of a visit. A part is a cluster within a block, named by its least leaf.
ROWS = f"id bigint, part bigint, near double, copy bigint, leaf bigint, vecs binary, {lv.VISIT}"


#: Rows of a cluster that are described in one group.
SALT_ROWS = 50_000


def link(x: np.ndarray, least: float) -> np.ndarray:
    """Component of each unit row, rows being linked if their cosine, rounded to nine decimals, is at least ``least``."""
    leaf, centre, radius = lv.compact(x, least)
    return _linked(x, least, leaf, centre, radius)[leaf]


def _linked(x: np.ndarray, least: float, leaf: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Component of each leaf."""
    angle = float(np.arccos(least))
    order = np.argsort(leaf, kind="stable")
    start = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]]) if len(x) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(x)])
    low = centre.astype(np.float32)
    parent = np.arange(len(start))
    widest = float(radius.max(initial=0))

    def compare(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        """The exact comparison, nearest first, of leaves that aren't joined yet."""
        nonlocal parent
        nearest_first = np.argsort(apart, kind="stable")
        i, j = i[nearest_first], j[nearest_first]
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            new = parent[a] != parent[b]
            a, b = a[new], b[new]
            pairs = size[a] * size[b]
            for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(pairs) // 1_000_000)) + 1):
                if not len(cut):
                    continue
                n = pairs[cut]
                which = np.repeat(cut, n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p, q = order[start[a[which]] + k // size[b[which]]], order[start[b[which]] + k % size[b[which]]]
                linked = np.zeros(len(a), bool)
                for s in range(0, len(p), 65536):
                    t = slice(s, s + 65536)
                    good = np.round(np.einsum("ij,ij->i", x[p[t]], x[q[t]]), 9) >= least
                    linked[which[t][good]] = True
                parent = lv.roots(parent, a[linked], b[linked])

    held: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(start), 2048):
        reach = np.cos(np.minimum(angle + radius[s : s + 2048] + widest, np.pi)) - 1e-5
        i, j = np.divmod(np.flatnonzero((low[s : s + 2048] @ low[s:].T >= reach[:, None].astype(np.float32)).ravel()), len(start) - s)
        i, j = (i + s)[i < j], (j + s)[i < j]
        apart = lv.angle_of(centre[i], centre[j])
        sure = apart + radius[i] + radius[j] <= angle - 1e-6
        parent = lv.roots(parent, i[sure], j[sure])
        open_ = ~sure & (apart <= angle + radius[i] + radius[j] + 1e-6)
        held.append((i[open_], j[open_], apart[open_]))
        if sum(len(h[0]) for h in held) > 2_000_000:  # bounds the memory, whatever the leaves
            compare(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        compare(*map(np.concatenate, zip(*held, strict=True)))
    return parent


def grown(df: DataFrame, record_id: str, vector: str, least: float, cells: ce.Cells) -> DataFrame:
    """ROWS of all blocks, in the checkpoint folder."""

    def table(n: int, **columns) -> pa.Table:
        names = {"id": pa.int64(), "part": pa.int64(), "near": pa.float64(), "copy": pa.int64(), "leaf": pa.int64(), "vecs": pa.binary(), "cell": pa.int64(), "slice": pa.int32(), "member": pa.bool_(), "own": pa.int64(), "pack": pa.binary()}
        return pa.table({k: columns[k] if k in columns else pa.nulls(n, kind) for k, kind in names.items()}, schema=pa.schema(list(names.items())))

    def run(key, t):
        if key[0].as_py() < 0:
            rep, copy = ce.copies_of(t)
            return table(len(rep), id=rep, copy=copy)
        at, block = key[0].as_py(), key[1].as_py()
        cell = ce.read_cell(t, 1, cells.dim)
        leaf, centre, radius = lv.compact(cell.x, least)
        part = _linked(cell.x, least, leaf, centre, radius)
        base = lv.own_number(at, block) << lv.LEAF_BITS
        row, ids = cell.reps
        near = np.round(np.einsum("ij,ij->i", cell.x, centre[leaf]), 9)
        out = [table(len(ids), id=pa.array(ids), part=pa.array(base + part[leaf[row]]), near=pa.array(near[row]), leaf=pa.array(base + leaf[row]))]
        if len(cells.centres) > 1 or cells.blocks[0] > 1:
            order = np.argsort(leaf, kind="stable")
            raw = [r.tobytes() for r in np.split(cell.raw[order], np.cumsum(np.bincount(leaf))[:-1])]
            out.append(table(len(raw), leaf=pa.array(base + np.arange(len(raw))), vecs=pa.array(raw, pa.binary())))
            pack = lv.packed(cell.x, leaf, centre, part=part)
            sent = lv.visits(cell.x, leaf, pack, at, block, cells)
            out.append(table(len(sent["cell"]), **sent))
        return pa.concat_tables(out)

    return stored(ce.route(df, record_id, vector, cells, 1).groupBy("cell", "block").applyInArrow(run, ROWS))


def _edges(found: DataFrame, least: float, cells: ce.Cells) -> DataFrame:
    """u, v: linked parts of different blocks."""

    def near(batches):
        for batch in batches:
            out = []
            for raw, centre, radius in zip(*(batch[c].to_pylist() for c in ("vecs", "centre", "radius")), strict=True):
                x = np.frombuffer(raw, np.float32).reshape(-1, cells.dim)
                out.append(x[lv.facing(x, centre, radius, least)].tobytes() or None)
            made = pa.array(out, pa.binary())
            yield pa.record_batch([batch["u"], batch["v"], batch["b"], made], names=["u", "v", "leaf", "near"]).filter(made.is_valid())

    def compare(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch["near"].to_pylist(), batch["vecs"].to_pylist(), strict=True):
                x, y = (ce.unit(np.frombuffer(raw, np.float32).reshape(-1, cells.dim)) for raw in (one, two))
                good.append(any((np.round(np.einsum("ij,kj->ik", x[s : s + 1024], y), 9) >= least).any() for s in range(0, len(x), 1024)))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    sent = found.where("pack is not null").select("cell", "slice", "member", "own", "pack")
    drawn = cut_lineage(sent.groupBy("cell", "slice").applyInArrow(lambda t: lv.sure_and_open(t, least, cells), f"u bigint, v bigint, {lv.FACING}"))
    open_ = drawn.where("a is not null").dropDuplicates(["a", "b"])
    kept, asked = found.where("vecs is not null").select("leaf", "vecs"), open_.withColumnRenamed("a", "leaf")
    sides = asked.join(lv.needed(kept, drawn.where("a is not null").select(F.col("a").alias("leaf"))), "leaf").select("u", "v", "b", "vecs", "centre", "radius")
    sides = cut_lineage(sides.mapInArrow(near, "u bigint, v bigint, leaf bigint, near binary"))
    exact = sides.join(lv.needed(kept, sides.select("leaf")), "leaf").select("u", "v", "near", "vecs").mapInArrow(compare, "u bigint, v bigint")
    return drawn.where("a is null").select("u", "v").union(exact)


def members(df: DataFrame, record_id: str, vector: str, least: float, cells: ce.Cells | None = None, **fitted) -> DataFrame:
    """id, first_id, size: every row in a cluster of two or more, with the least id and the size of its cluster. ``fitted``: arguments of ``cells.fit``."""
    cells = cells or ce.fit(df, record_id, vector, floor=least, **fitted)
    found = grown(df, record_id, vector, least, cells)
    rows = found.where("id is not null").groupBy("id").agg(F.min("part").alias("part"), F.collect_set("copy").alias("copies"))
    if len(cells.centres) > 1 or cells.blocks[0] > 1:
        rows = rows.join(components(_edges(found, least, cells)).withColumnRenamed("u", "part"), "part", "left").withColumn("part", F.coalesce("root", "part"))
    ids = rows.select(F.col("part").alias("root"), F.explode(F.array_union(F.array("id"), "copies")).alias("id")).distinct()
    first = ids.groupBy("root").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return ids.join(first, "root").select("id", "first_id", "size")


def leaf_sizes(df: DataFrame, record_id: str, vector: str, least: float, typical: int = 3, cells: ce.Cells | None = None, **fitted) -> DataFrame:
    """leaf, size, typical_ids: the leaves of the tree with their rows and the ``typical`` nearest to their centres, nearest first, then the smaller id."""
    cells = cells or ce.fit(df, record_id, vector, floor=least, **fitted)
    found = grown(df, record_id, vector, least, cells)
    rows = found.where("id is not null").groupBy("id").agg(F.min("leaf").alias("leaf"), F.max("near").alias("near"), F.collect_set("copy").alias("copies"))
    rows = rows.select("leaf", "near", F.explode(F.array_union(F.array("id"), "copies")).alias("id")).dropDuplicates(["id"])
    size = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    return size.join(_typical(rows, "leaf", typical), "leaf")


def _typical(rows: DataFrame, key: str, typical: int) -> DataFrame:
    """The ids of largest ``near`` of each key; at most ``typical`` of a key leave a task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("near"), "id"))
    best = rows.withColumn("place", place).where(F.col("place") <= typical).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("best"))
    return best.select(key, F.col("best.id").alias("typical_ids"))


def describe(df: DataFrame, record_id: str, vector: str, group: str, found: DataFrame, typical: int = 3, dim: int = ce.DIM) -> DataFrame:
    """first_id, size, typical_ids (nearest to the centre first) and the number of recorded groups of each cluster of ``found``; ``recorded`` lists the groups."""
    rows = df.select(F.col(record_id).alias("id"), F.col(vector).cast("array<float>").alias("x")).dropDuplicates(["id"]).join(found, "id")
    salt = F.pmod(F.xxhash64("id"), 1 + F.floor(F.col("size") / SALT_ROWS)).cast("int")  # a large cluster is several groups
    rows = rows.select("first_id", salt.alias("salt"), "id", "x").repartition("first_id", "salt")  # once, for both the centres and the distances from them
    double = F.transform("x", lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, e: s + e * e))
    sums = rows.withColumn("n", norm).groupBy("first_id", "salt").agg(F.min("id").alias("least"), *[F.sum(F.get("x", F.lit(k)).cast("double") / F.col("n")).alias(f"c{k}") for k in range(dim)])
    whole = sums.groupBy("first_id").agg(F.collect_set("salt").alias("salts"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(dim)])  # one of SALT_ROWS rows each
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, e: s + e * e))
    centres = whole.select("first_id", F.explode("salts").alias("salt"), F.array(*[f"c{k}" for k in range(dim)]).alias("c")).withColumn("length", length)
    near = F.round(F.aggregate(F.zip_with(double, "c", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) / norm / F.greatest("length", F.lit(1e-12)), 9)
    best = _typical(rows.join(centres, ["first_id", "salt"]).select("first_id", "id", near.alias("near")), "first_id", typical)
    sets = found.groupBy("first_id").agg(F.max("size").alias("size"))
    groups = recorded(df, record_id, group, found).groupBy("first_id").agg(F.count("grp").alias("groups"))
    return sets.join(best, "first_id").join(groups, "first_id").select("first_id", "size", "typical_ids", "groups")


def recorded(df: DataFrame, record_id: str, group: str, found: DataFrame) -> DataFrame:
    """first_id, grp, rows: the groups under which the rows of each cluster are recorded, null ones too."""
    rows = df.select(F.col(record_id).alias("id"), F.col(group).alias("grp")).dropDuplicates(["id"]).join(found, "id")
    return rows.groupBy("first_id", "grp").agg(F.count(F.lit(1)).alias("rows"))
