import base64
import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomscope.llm import abuse, abuse_examples, cells, clusters, leaves, neighbours, packing, queries, tokenizer, topn
from roomscope.llm.abuse_words import Reader, ordinary
from tests.conftest import DATA
from tests.oracle import assert_same

VOCABULARY = tokenizer.vocabulary("byte_bpe_50k")
VECTORS = "id long, v array<float>, cell string, ids string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, DATA, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("large", [0, 3, 1000])
def test_top_n(spark, large):
    r = random.Random(1)
    rows = [(k % 4 and k % 4 - 1 or None, i, r.choice([None, float("nan"), -1.0, 0.0, 0.5, 0.5, 0.5001, float("inf"), r.random()]), "x") for i, k in enumerate(r.choices(range(8), k=400))]
    rows += rows[:20]
    got = topn.top_n(spark.createDataFrame(rows, "g long, i long, s double, bin string"), "g", "i", "s", 3, large, 4)
    want = set()
    for g in {x[0] for x in rows} - {None}:
        best = sorted({(-x[2], x[1]) for x in rows if x[0] == g and x[2] is not None and x[2] == x[2]})[:3]
        want |= {(g, i, -s, k + 1) for k, (s, i) in enumerate(best)}
    assert {tuple(x) for x in got.collect()} == want
    assert topn.top_n(spark.createDataFrame([], "g long, i long, s double"), "g", "i", "s", 3).count() == 0


TEXTS = ["", " ", "a", "Don't stop, it's 12 o'clock!", "a" * 5000, "ab" * 3000, " \n\t\r\n  x", "<|endoftext|>", "naïve café — 你好 🏡🏡", "​­﻿", "x" * 70 + " " + "y" * 70, "\x00\x01", "we'll've they're I'D"]


def test_tokenizer_equals_the_library():
    import tiktoken

    own = tokenizer.BytePairEncoder.from_file(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    for t in TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD7FF)])) for _ in range(200)) for _ in range(50)]:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t
    assert own.encode(None) == []


def test_encode_corpus(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS])]
    df = spark.createDataFrame(rows, "k long, text string, ids string")
    own = tokenizer.encoder(VOCABULARY)
    got = tokenizer.encode_corpus(df, "k", "text", VOCABULARY)
    assert {x.doc_id: x.ids for x in got.collect()} == {i: own.encode(t) for i, t, _ in rows}
    assert tokenizer.encode_corpus(df.limit(0), "k", "text", VOCABULARY).count() == 0


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_containers(spark, block):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 40, 60, 100, 101, 250, None])) for i in range(150)] + [(None, 5), (7, 1_003)]
    df = spark.createDataFrame(rows + rows[:9], "doc_id long, size long")
    got = packing.pack_containers(df, 100, 8, 6_000.0, block).collect()
    assert len({x.container_id for x in got}) == len(got)
    placed = {}
    for x in got:
        assert x.tokens == sum(x.sizes) <= 100 and len(x.sizes) <= 8 and (sum(s * s for s in x.sizes) <= 6_000 or len(x.sizes) == 1)
        for i, s in zip(x.doc_ids, x.sizes, strict=True):
            placed.setdefault(i, []).append(s)
    want = {}
    for i, s in set(rows):
        want[i] = want.get(i, 0) + (s or 0)
    assert {i: sum(s) for i, s in placed.items()} == want
    assert packing.pack_containers(df.limit(0)).count() == 0


def test_packing_is_close_to_the_least_number():
    sizes = np.random.default_rng(1).integers(1, 700, 3000)
    homes = packing.best_fit(sizes)
    assert homes.max() + 1 <= np.ceil(sizes.sum() / packing.CAPACITY) * 1.01
    assert np.bincount(homes, weights=sizes).max() <= packing.CAPACITY


def vectors():
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 64))
    x = (centres[r.integers(0, 40, 500)] + 0.45 * r.standard_normal((500, 64))).astype(np.float32)
    x[100:140] = x[7]  # copies
    x[140] = x[8] * 3
    x[141:150] = (x[9] + x[10]) / 2 + 0.02 * r.standard_normal((9, 64))
    rows = [(i, v.tolist(), "c", "d") for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [0.0] * 64), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (906, [None] + [1.0] * 63), (None, [1.0] * 64)]
    return x.astype(np.float64), rows + [(*b, "c", "d") for b in bad] + rows[5:9] + rows[120:125]


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 9)


@pytest.mark.parametrize("cell_rows", [10_000, 60])
def test_neighbours_against_brute_force(spark, cell_rows):
    x, rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    s = cosines(x)
    np.fill_diagonal(s, -9)
    best = {i: [(s[i, j], j) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5]] for i in range(len(x))}
    near = neighbours.neighbours(df, "id", "v", 5, 0.85, cell_rows=cell_rows)
    got = {(r.id, r.place): r.near_id for r in near.collect()}
    want = {(i, k + 1): j for i, b in best.items() for k, (c, j) in enumerate(b) if c >= 0.85}
    assert sum(got.get(k) == j for k, j in want.items()) >= 0.99 * len(want)
    if cell_rows == 10_000:
        assert got == want
    near = neighbours.neighbours(df, "id", "v", 5, queries=lambda c: F.pmod(c, F.lit(10)) == 0, cell_rows=cell_rows).collect()
    assert {r.id for r in near} == set(range(0, 500, 10))
    hit = sum(r.near_id in {j for _, j in best[r.id]} for r in near)
    assert hit >= (0.9 if cell_rows == 60 else 1.0) * 5 * 50
    assert neighbours.neighbours(df.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("cell_rows", [10_000, 60])
def test_clusters_against_brute_force(spark, cell_rows):
    x, rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in np.argwhere(cosines(x) >= 0.85):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    root = [find(i) for i in range(len(x))]
    want = {i: (r, root.count(r)) for i, r in enumerate(root) if root.count(r) > 1}
    got = {r.id: (r.first_id, r["size"]) for r in clusters.members(df, "id", "v", 0.85, cell_rows=cell_rows).collect()}
    assert got == want
    assert clusters.members(df.limit(0), "id", "v", 0.85).count() == 0


def brute_clusters(x, least=0.85):
    root = np.arange(len(x))
    i, j = np.nonzero(cosines(x) >= least)
    root = leaves.roots(root, i, j)
    size = np.bincount(root, minlength=len(x))
    return {k: (int(r), int(size[r])) for k, r in enumerate(root) if size[r] > 1}


def test_cells_in_several_blocks(spark):
    """Vectors of one cell that lie in different blocks meet, too."""
    x, rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    fitted = cells.fit(df, "id", "v", cell_rows=120, floor=0.85)
    cut = dataclasses.replace(fitted, blocks=np.full(len(fitted.centres), 3))
    assert {r.id: (r.first_id, r["size"]) for r in clusters.members(df, "id", "v", 0.85, cells=cut).collect()} == brute_clusters(x)
    one = dataclasses.replace(fitted, centres=fitted.centres[:1], blocks=np.array([4]))
    assert {r.id: (r.first_id, r["size"]) for r in clusters.members(df, "id", "v", 0.85, cells=one).collect()} == brute_clusters(x)
    s = cosines(x)
    np.fill_diagonal(s, -9)
    want = {(i, k + 1): j for i in range(len(x)) for k, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5]) if s[i, j] >= 0.85}
    for c in (cut, one):
        got = {(r.id, r.place): r.near_id for r in neighbours.neighbours(df, "id", "v", 5, 0.85, cells=c).collect()}
        assert got == want
    probing = dataclasses.replace(cut, probes=len(cut.centres))
    near = neighbours.neighbours(df, "id", "v", 5, queries=lambda c: F.pmod(c, F.lit(10)) == 0, cells=probing).collect()
    assert sum(r.near_id in np.argsort(-s[r.id], kind="stable")[:5] or s[r.id, r.near_id] >= np.sort(s[r.id])[-5] for r in near) >= 0.98 * 250


@pytest.mark.parametrize("dim", [6, 512])
def test_vectors_of_other_lengths(spark, dim):
    r = np.random.default_rng(6)
    x = (r.standard_normal((60, dim))[r.integers(0, 60, 300)] + 0.35 * r.standard_normal((300, dim))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0] * (dim + 1))], "id long, v array<float>").repartition(3)
    got = {r.id: (r.first_id, r["size"]) for r in clusters.members(df, "id", "v", 0.85, cell_rows=60, dim=dim, exact=True).collect()}
    assert got == brute_clusters(x.astype(np.float64))
    near = neighbours.neighbours(df, "id", "v", 5, 0.85, cell_rows=60, dim=dim).collect()
    s = cosines(x.astype(np.float64))
    assert near and all(s[r.id, r.near_id] >= 0.85 and abs(s[r.id, r.near_id] - r.cosine) < 1e-8 for r in near)


def test_exact_reach_meets_every_link():
    """Two vectors of the floor's cosine, however they lie to the border between two cells: one visits the other's."""
    r = np.random.default_rng(9)
    reach = cells.reach_of(0.85, 3, True)
    a = cells.unit(r.standard_normal((20_000, 3)))
    off = r.standard_normal((20_000, 3))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    b = 0.85 * a + np.sqrt(1 - 0.85**2) * cells.unit(off)
    centres = cells.unit(r.standard_normal((30, 3)))
    ha, hb = np.argmax(a @ centres.T, axis=1), np.argmax(b @ centres.T, axis=1)
    rows = np.arange(len(a))
    assert ((ha == hb) | (cells.beyond(a @ centres.T, ha, centres)[rows, hb] <= reach) | (cells.beyond(b @ centres.T, hb, centres)[rows, ha] <= reach)).all()


def test_leaves_are_compact_and_their_records_safe():
    x = cells.unit(vectors()[0])
    leaf, centre, radius = leaves.compact(x, 0.85)
    s = x @ x.T
    assert all((s[np.ix_(leaf == k, leaf == k)] >= 0.85).all() for k in range(leaf.max() + 1))
    pack = leaves.packed(x, leaf, centre, need=np.full(len(centre), 0.85))
    seen = leaves.directions(pack["centre"], 64)
    assert (leaves.angle_of(x, seen[leaf]) <= pack["radius"].astype(float)[leaf]).all()
    assert (pack["need"].astype(float) <= 0.85).all()


def test_leaf_sizes(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    told = clusters.leaf_sizes(df, "id", "v", 0.85, cell_rows=60).collect()
    assert sum(r["size"] for r in told) == len(x) and len({r.leaf for r in told}) == len(told)
    s = cosines(x)
    assert all(1 <= len(r.typical_ids) <= 3 and s[np.ix_(r.typical_ids, r.typical_ids)].min() >= 0.85 for r in told)
    assert clusters.leaf_sizes(df.limit(0), "id", "v", 0.85).count() == 0


def test_exact_nearest(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    s = cosines(x)
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(0, 500, 10) for j in sorted(range(500), key=lambda j: (-s[i, j], j))[:5] if s[i, j] >= 0.85}
    for block in (10, 1000):
        got = neighbours.exact_nearest(df, "id", "v", lambda c: F.pmod(c, F.lit(10)) == 0, 5, 0.85, block=block).collect()
        same = {(r.id, r.near_id) for r in got}
        assert len(got) == len(want) and sum(p in want or s[p] == min(s[q] for q in want if q[0] == p[0]) for p in same) == len(want)


def pairs_beside_near_copies():
    """Rows of which a third are near copies of one vector, the others pairs at a cosine just over 0.85 in all directions."""
    r = np.random.default_rng(8)
    a = cells.unit(r.standard_normal((400, 64)))
    off = r.standard_normal((400, 64))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    b = 0.86 * a + np.sqrt(1 - 0.86**2) * cells.unit(off)
    near = cells.unit(r.standard_normal((1, 64))) + 0.02 * r.standard_normal((400, 64))
    return np.concatenate([a, b, near]).astype(np.float32)


def test_clusters_beside_a_third_of_near_copies(spark):
    x = pairs_beside_near_copies()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)
    got = {r.id: (r.first_id, r["size"]) for r in clusters.members(df, "id", "v", 0.85, cell_rows=40).collect()}
    assert got == {i: (i % 400, 2) if i < 800 else (800, 400) for i in range(1200)}


def test_neighbours_beside_a_third_of_near_copies(spark):
    x = pairs_beside_near_copies()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)
    near = neighbours.neighbours(df, "id", "v", 5, 0.85, cell_rows=40).where("id < 800").collect()
    assert all(abs(r.id - r.near_id) == 400 for r in near) and len(near) >= 0.995 * 800


def test_nearest_without_floor_beside_a_third_of_near_copies(spark):
    x = pairs_beside_near_copies()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)
    s = cosines(x.astype(np.float64))
    np.fill_diagonal(s, -9)
    near = neighbours.neighbours(df, "id", "v", 5, queries=lambda c: F.pmod(c, F.lit(10)) == 0, cell_rows=40).collect()
    hit = sum(r.near_id in np.argsort(-s[r.id], kind="stable")[:5] for r in near)
    assert hit >= 0.95 * 5 * 120


def test_links_of_leaves_against_brute_force():
    x = cells.unit(vectors()[0])
    for least in (0.5, 0.85, 0.95):
        s = np.round(x @ x.T, 9) >= least
        label = clusters.link(x, least)
        for i, j in np.argwhere(s):
            assert label[i] == label[j]
        reach = np.linalg.matrix_power(s.astype(float), 32) > 0
        assert all(reach[i, j] for i in range(0, 500, 7) for j in range(500) if label[i] == label[j])


def test_describe(spark):
    x, rows = vectors()
    df = spark.createDataFrame([(*r[:2], i % 3) for i, r in enumerate(rows)], "id long, v array<float>, g long")
    found = clusters.members(df, "id", "v", 0.85)
    told = clusters.describe(df, "id", "v", "g", found).collect()
    assert {(r.first_id, r["size"]) for r in told} == {(r.first_id, r["size"]) for r in found.collect()}
    assert all(1 <= len(r.typical_ids) <= 3 and r.groups <= 3 for r in told)
    rooms = clusters.recorded(df, "id", "g", found).collect()
    assert sum(r.rows for r in rooms) == found.count()


def test_words_lose_their_disguise():
    for text in ("d.u.m.b.a.s.s", "d u m b a s s", "dumbаss", "du­mbass", "DUMBASS", "dumbaaaaass", "dumb‌ass"):
        assert abuse.words(text) in (["dumbass"], ["dumbas"]), text
    assert abuse.words("V3rp1$$ d1ch") == ["verpiss", "dich"]
    assert abuse.words(None) == abuse.words(" \n") == abuse.words("") == []
    assert [len(w) for w in abuse.words("x" + "ab" * 40)] == [24, 24, 24, 9]
    assert abuse.words("<p>you <b>idiot</b></p> <img alt=\"you fool\">") == ["you", "idiot", "you", "fool"]
    assert abuse.words("idiot2 ni66er id7788abc") == ["idiotz", "nigger", "#x", "abc"]


def test_unknown_words_mean_nothing_and_torn_ones_are_read():
    assert abuse.words("you id<b>io</b>t &#105;diot Te v_o_y a") == ["you", "idiot", "idiot", "te", "voy", "a"]
    read = Reader({"you", "are", "an", "idiot", "asshole", "the", "house", "on", "lane", "a"}, {"idiot", "asshole"}, {"idiom", "idot"})
    for text in ("you are an id-iot", "youareanidiot", "you_are an idoit", "you are an **idiot**", "you are an 1diot", "you are an id*ot", "you are an toidi"):
        assert read(abuse.words(text)) == ["you", "are", "an", "idiot"], text
    assert read(["assh0le", "idiots", "assholes"]) == ["#u", "idiot", "asshole"] and read(["idot", "idiom"]) == ["#u", "#u"]
    assert read(abuse.words("The house on Quinfel Lane")) == read(abuse.words("The house on Zorbathwy Lane")) == ["the", "house", "on", "#u", "lane"]
    assert read(["b"] * 9 + ["you"]) == ["#u", "#u", "you"] and read([]) == []


def test_innocent_words_are_no_kind_of_offence():
    bad = {w for w, k in abuse.kinds_of_words().items() if k < abuse.ADDRESS} | abuse.strong_words()
    innocent = "fini for pauvre type ton tes tus less good half like this sent con nobody gens gros hommes moins pedazo".split()
    assert not bad & set(innocent)
    assert {"connard", "titten", "polla", "vermin", "refugees", "idiot", "untermenschen"} <= bad
    known = {"a", "frame", "you", *abuse.strong_words()}
    plain = ordinary(Reader(known, abuse.strong_words()), {"crooked"}, frozenset({"crook"}))
    assert Reader(known, abuse.strong_words(), plain)(abuse.words("a crooked frame, you crooks")) == ["a", "#u", "frame", "you", "crook"]


def test_frames_without_their_offence_and_evened_windows():
    rng = random.Random(3)
    made = [abuse_examples.fill(p, rng, abuse_examples.FILLERS) for own in abuse_examples.frames() for p in own]
    assert len(made) > 80 and not {w for s in made for w in abuse.words(s)} & {"idiot", "moron", "vermin", "refugees", "connard", "gilipollas", "arschloch"}
    rows = [(["you", "are", "an", "idiot"], 1)] * 6 + [(["the", "view", "is", "good"], 0)] * 6
    out = abuse.evened(rows, {"idiot"}, 1)
    assert [y for _, y in out] == [y for _, y in rows] and out[:6] == rows[:6]
    put = [w for row, _ in out[6:] for w in row]
    assert {"you", "are", "an"} & set(put) and "idiot" not in put and [len(row) for row, _ in out] == [4] * 12


def test_windows_cover_all_words():
    for n in (1, 15, 16, 17, 40, 99):
        assert {k for s in abuse.windows(n) for k in range(s, min(n, s + abuse.WINDOW))} == set(range(n))


def test_gradients_against_differences():
    net = abuse.Network({k: v.astype(np.float64) for k, v in abuse.Network.fresh(1).w.items()})
    index, mask, vocabulary = abuse.indexed([["you", "fool", "you"], ["a", "quiet", "room", "here"]])
    y = np.array([1.0, 0.0])

    def loss():
        x = net.embed(vocabulary)[0]
        g = net.gates(x)
        p = net.forward({d: g[d][index] for d in "fb"}, mask)[0]
        return float(np.mean(np.logaddexp(0, p) - y * p))

    grads = net.gradients(index, mask, y, vocabulary)
    r = np.random.default_rng(0)
    for k in ("fx", "fh", "bc", "bh", "ax", "av", "o"):
        flat, g = net.w[k].reshape(-1), np.asarray(grads[k]).reshape(-1)
        for i in r.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(g[i], abs=2e-4)


def test_classifier_on_held_out_sentences(spark, tmp_path):
    """Folds of the labels: neither a sentence of the left-out fold nor a variation of it is fitted on; the grammar can't make the harmless ones, and few of the others."""
    labels = spark.read.parquet(str(DATA / "content_labels.parquet"))
    known = sorted({(r.text, r.label) for r in labels.select("text", "label").collect()})
    net = abuse.fit(known[::2], 2500, 3)
    rest = known[1::2]
    scores = abuse.Scorer(net).texts([t for t, _ in rest])
    y = np.array([y == 1 for _, y in rest])
    assert (scores[y] >= abuse.THRESHOLD).mean() >= 0.9 and (scores[~y] < abuse.THRESHOLD).mean() >= 0.85
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n"), (3, "The room is quiet. " * 500), (4, "The room is quiet. " * 300 + "You worthless idiot, shut your mouth. " + "The room is quiet. " * 300), (5, "nice <you are a worthless idiot, shut your mouth> room")], "id long, text string")
    got = {r.id: r.s for r in df.select("id", abuse.score_column(F.col("text"), net).alias("s")).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[4] > 0.8 > got[3] and got[5] > 0.8
    assert df.limit(0).select(abuse.score_column(F.col("text"), net)).count() == 0
    abuse.save(spark, net, str(tmp_path / "w"))
    again = abuse.Scorer(abuse.load(spark, str(tmp_path / "w"))).texts([t for t, _ in rest])
    assert np.allclose(again, scores, atol=1e-6)


def test_scorer_equals_the_network():
    net = abuse.Network.fresh(3)
    rows = [["you", "fool", "you"], ["a", "quiet", "room", "here"] * 6]
    index, mask, vocabulary = abuse.indexed(rows)
    by_word = net.gates(net.embed(vocabulary)[0])
    want = abuse.sigmoid(net.forward({d: by_word[d][index] for d in "fb"}, mask)[0])
    assert np.allclose(abuse.Scorer(net).windows(rows), want, atol=1e-5)
