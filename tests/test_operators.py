from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomscope.functions import columns as c
from roomscope.functions import imaging, models
from roomscope.operators import graph, intervals, joins, rooms, stages
from roomscope.operators import references as rf

D = lambda d: datetime(2025, 1, d)
REFS = "id long, ref string, loaded_at timestamp_ntz, key string, parent string"


def orphans(spark, refs, parents, log, **how):
    r = rf.references(spark.createDataFrame(refs, REFS), "t", "p", "id", "ref", "loaded_at", rf.uuid_key)
    p = rf.parent_rows(spark.createDataFrame(parents, "id string, loaded_at timestamp_ntz"), "p", "id", "loaded_at", rf.uuid_key)
    d = rf.log_rows(spark.createDataFrame(log, "table_name string, record_key string, action string, logged_at timestamp_ntz, log_id long"), "table_name", "record_key", "action", "logged_at", "log_id", {"p": rf.uuid_key})
    return {(x.record_id, x.period, x.missing, x.deleted, x.late) for x in rf.find_orphans([r], [p, d], **how).collect()}


@pytest.mark.parametrize("how", [{}, {"hot_rows": 1, "salts": 3}])
def test_orphans(spark, how):
    refs = [(1, "A-b", D(5)), (1, "A-b", D(5)), (2, "zz", D(5)), (3, " ", D(5)), (4, None, D(5)), (5, "c", D(5)), (6, "d", D(5)), (7, "a b", D(1)), (8, "--", D(5)), (9, "ab", None), (None, "q", D(5))]
    refs = [(*r, "clash", "clash") for r in refs]
    parents = [("ab", D(3)), ("AB", D(2)), ("c", D(1)), ("d", D(1)), (None, D(1))]
    log = [("p", "C", "delete", D(3), 1), ("p", "d", "delete", D(3), 2), ("p", "D", "restore", D(4), 3), ("other", "ab", "delete", D(9), 4), ("p", "zz", "delete", D(9), 5)]
    assert orphans(spark, refs, parents, log, **how) == {(2, "2025-01", True, True, False), (5, "2025-01", False, True, False), (7, "2025-01", False, False, True), (8, "2025-01", True, False, False), (None, "2025-01", True, False, False)}


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [], []) == set()


def brute_periods(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][2] |= s < out[-1][1]
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, False])
    return out


@pytest.mark.parametrize("slice_rows", [1, 7, 10**7])
def test_intervals_against_brute_force(spark, slice_rows):
    r = np.random.default_rng(1)
    rows = [(i, int(k), s / 1000, (s + n) / 1000, "x") for i, (k, s, n) in enumerate(zip(r.integers(0, 6, 300), r.integers(-20, 400, 300).tolist(), r.integers(-1, 9, 300).tolist(), strict=True))]
    rows += [(900, 1, None, 2.0, "x"), (901, 1, float("nan"), 2.0, "x"), (902, 1, 0.0, float("inf"), "x"), rows[0]]
    df = spark.createDataFrame(rows, "id long, entity_id long, a double, b double, start_ms string")
    got = intervals.merged_and_gaps(intervals.intervals(df, "id", "entity_id", "a", "b"), slice_rows)
    want = set()
    for k in range(6):
        p = brute_periods([(round(a * 1000), round(b * 1000)) for i, e, a, b, _ in rows if e == k and i < 900 and round(b * 1000) > round(a * 1000)])
        want |= {(k, "merged", s, e) for s, e, o in p if o} | {(k, "gap", x[1], y[0]) for x, y in zip(p, p[1:])}
    assert {tuple(x) for x in got.collect()} == want
    assert intervals.merged_and_gaps(intervals.intervals(df.limit(0), "id", "entity_id", "a", "b")).count() == 0


def test_final_score_cases(spark):
    cases = [(0.4, "{}", 0.4), (0.0, "{}", 0.5), (None, "{}", 0.5), (0.4, '{"hero_global":true,"hero_room":true}', 0.9), (0.9, '{"hero_global":true}', 1.0), (0.4, '{"hero_priority":"3"}', 0.55), (0.4, '{"hero_priority":2.7}', 0.5), (0.1, '{"hero_priority":-4}', -0.1), (0.4, '{"hero_room":"false"}', 0.6), (0.4, '{"exclude":true}', 0.0), (0.4, '{"hero_priority":null}', 0.5), (0.4, '{"exclude":true,"hero_priority":"abc"}', 0.5), (0.4, None, 0.4), (0.4, "[1]", 0.5), (0.4, '{"hero_room":0.0,"hero_global":[]}', 0.4)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, b double, m string, want double")
    rows = df.select("m", "want", c.final_score(F.col("b"), F.col("m"), F.lit(None).cast("boolean")).alias("got")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.want), r


def test_keys_labels_and_tiers(spark):
    r = spark.createDataFrame([("s3://b/a/b.jpg", "", "kitchen", float("nan")), ("s3://b", "", "", 0.061), ("a/b.jpg", "Den", "kitchen", 0.06), ("s3://photos/x.jpg", None, None, None)], "u string, o string, l string, v double")
    got = [tuple(x) for x in r.select(c.object_key(F.col("u")), c.effective_label(F.col("o"), F.col("l")), c.depth_tier(F.col("v"))).collect()]
    assert got == [("a/b.jpg", "kitchen", "low"), ("", "unknown", "high"), ("a/b.jpg", "Den", "medium"), ("x.jpg", "unknown", "low")]


def test_slices_and_small_images():
    for n in (2, 8, 15, 19, 20, 29, 30, 64):
        s, e = n // 3 - 10, n // 3 + 10
        assert list(range(n))[imaging.py_slice(n, s, e)] == list(range(n))[s:e]
    with pytest.raises(ValueError):
        imaging.composition(np.ones((1, 1)))
    black = np.zeros((30, 30))
    assert (imaging.sharpness(black), imaging.composition(black), imaging.exposure(np.zeros((30, 30, 3)))) == (0, 0, 0)
    assert imaging.depth(np.ones((4, 4))) == (0, 1)


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = r.integers(0, 300, (220, 2)).tolist()
    parent = list(range(300))

    def find(a):
        return a if parent[a] == a else find(parent[a])

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(tuple(x) for x in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert all(got.get(k, k) == find(k) for k in range(300))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_room_sub_clusters(spark, block):
    at = lambda *deg: [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in deg]
    chain = [(i, 1, "a", x) for i, x in enumerate(at(0, 41, 82, 200))]
    broken = [(10, 1, "b", [1.0, 0.0]), (11, 1, "b", None), (12, 1, "b", [0.0, 1.0]), (20, 1, "c", [0.0, 0.0]), (21, 1, "c", [1.0, 0.0]), (30, 2, "a", [1.0, 0.0])]
    got = rooms.numbered(rooms.sub_clusters(spark.createDataFrame(chain + broken, "id long, job_id long, label string, x array<double>"), 0.3, block))
    assert {x.id: (x.first_id, x.cluster_seq) for x in got.collect()} == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (3, 2), 10: (10, 3), 11: (10, 3), 12: (10, 3), 20: (20, 4), 21: (20, 4), 30: (30, 1)}


def test_one_busy_entity_is_cut_into_slices(spark):
    """All intervals of one entity start within a second, and still go to several slices."""
    rows = spark.range(1000).selectExpr("cast(1 as bigint) entity", "id * 2 start_ms", "id * 2 + 1 end_ms", "cast(1 as bigint) covered")
    assert intervals._sliced(rows, 100).select("part").distinct().count() >= 10
    assert intervals._sliced(rows, 10_000).select("part").distinct().count() == 1
    assert intervals.periods(rows.select("entity", "start_ms", "end_ms"), 100).count() == 1000


def test_far_times_keep_their_periods(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1e10), (2, 1, 5.0, 6.0), (3, 1, 1e10, 2e10)], "id long, e long, a double, b double")
    assert [tuple(r) for r in intervals.periods(intervals.intervals(df, "id", "e", "a", "b")).collect()] == [(1, 0, 20_000_000_000_000, True)]


def test_edits_and_states(spark):
    rows = spark.createDataFrame([(i, i, float(i), i + 1.0) for i in range(6)], "id long, order_index int, in_time double, out_time double")
    edits = spark.createDataFrame([(0, 1, "remove", 0.0), (1, 1, "remove", 0.0), (1, 2, "restore", 0.0), (2, 3, "trim", 0.5), (2, 1, "trim", 0.1), (3, 1, "move", 9.0), (9, 1, "remove", 0.0)], "id long, seq int, op string, value double")
    got = {r.id: (r.order_index, r.in_time, r.out_time) for r in joins.fold_edits(rows, edits, "id").collect()}
    assert got == {1: (1, 1.0, 2.0), 2: (2, 2.0, 2.5), 3: (9, 3.0, 4.0), 4: (4, 4.0, 5.0), 5: (5, 5.0, 6.0)}
    assert {r.id for r in joins.fold_edits(rows, edits.limit(0), "id").collect()} == set(range(6))


def test_stages_start_anew(spark, tmp_path):
    calls = []

    def stage(name):
        def run(df):
            calls.append(name)
            return df.withColumn(name, F.lit(1))

        return name, run

    made = [stage("a"), stage("b"), stage("c")]
    source = spark.range(3)
    assert stages.run_stages(spark, source, made, str(tmp_path)).columns == ["id", "a", "b", "c"]
    assert stages.run_stages(spark, source, made, str(tmp_path), start=2).count() == 3
    assert calls == ["a", "b", "c", "c"]
    cached = spark.createDataFrame([(1, "2030-01-01 00:00:00"), (2, "2000-01-01 00:00:00")], "id long, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    assert {r.id for r in stages.not_cached(source, cached, "id", "2024-01-01 00:00:00").collect()} == {0, 2}


def test_models(spark):
    def load():
        return lambda images: [[float(len(i)), 0.0] if len(i) < 4 else 1 / 0 for i in images]

    df = spark.createDataFrame([(0, b"abc"), (1, None), (2, b"toolong")], "id long, image binary")
    got = {r.id: r.v for r in df.select("id", models.embedding(F.col("image"), load, "stub").alias("v")).collect()}
    assert got == {0: [1.0, 0.0], 1: None, 2: None}
    depth = df.where("id = 0").select(models.depth_map(F.col("image"), lambda: lambda images: [np.ones((2, 3)) for _ in images], "depths").alias("d")).first().d
    assert depth == [[1.0] * 3] * 2
    assert models.pick_device(lambda d: d == "cuda") == "cuda" and models.pick_device(lambda d: False) == "cpu"


def test_grids_missing_broken_and_many(spark):
    r = np.random.default_rng(3)
    g = r.uniform(0, 255, (5, 12, 15))
    for k, one in enumerate(g):
        assert imaging.sharpness(g)[k] == pytest.approx(imaging.sharpness(one))
        assert imaging.composition(g)[k] == pytest.approx(imaging.composition(one))
        d = (one - one.min()) / (one.max() - one.min() + 1e-8)
        assert imaging.depth(g)[0][k] == pytest.approx(d.var()) and imaging.depth(g)[1][k] == (np.histogram(d, 10)[0] > 0.05 * d.size).sum()
    df = spark.createDataFrame([(0, [1.0] * 4), (1, None), (2, [1.0] * 3), (3, [float("nan")] + [1.0] * 3)], "i int, g array<double>")
    rows = {x.i: (x.s, x.d) for x in df.select("i", imaging.gray_scores(F.col("g"), 2, 2).alias("s"), imaging.depth_metrics(F.col("g"), 2, 2).alias("d")).collect()}
    assert all(tuple(rows[i][0]) == (0.5, 0.5, 0.5) and tuple(rows[i][1]) == (0.0, 1) for i in (1, 2, 3))
    assert rows[0][0].sharpness == 0 and tuple(rows[0][1]) == (0.0, 1)
