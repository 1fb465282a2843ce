"""What large tables need of the operators: many small groups to a call, and work that grows with the rows."""

from __future__ import annotations

import itertools
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.vector import dot
from strandline.operators import assign as A
from strandline.operators import blocks as B
from strandline.operators import graph as G
from strandline.operators import identity as I
from strandline.operators import joins as J
from strandline.operators import quality as Q
from strandline.operators import tracking as K


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_optimal_matches_takes_many_frames_at_once_and_skips_what_has_no_reward(spark):
    rows = [(f, f"g{i}", f"p{j}", r) for f in range(50) for i, j, r in ((0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.8), (2, 2, 0.5), (2, 2, 0.7), (3, 3, None))]
    out = A.optimal_matches(spark.createDataFrame(rows, "frame int, g string, p string, iou double"), "frame", "g", "p", "iou")
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(f, *x) for f in range(50) for x in (("g0", "p1", 0.8), ("g1", "p0", 0.8), ("g2", "p2", 0.7))]


@pytest.mark.parametrize("seed", range(60))
def test_matched_is_the_best_of_all_choices(seed):
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 4), rnd.randint(1, 4)
    value = {p: rnd.random() for p in itertools.product(range(n), range(m)) if rnd.random() < 0.6}
    least = 0.3

    def best(rows):
        if not rows:
            return 0.0
        i, *rest = rows
        free = best(rest)
        return max([free, *(v - least + best_without(rest, {j}) for (k, j), v in value.items() if k == i)])

    def best_without(rows, used):
        if not rows:
            return 0.0
        i, *rest = rows
        return max([best_without(rest, used), *(v - least + best_without(rest, used | {j}) for (k, j), v in value.items() if k == i and j not in used)])

    got = A.matched(value, least)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert sum(value[p] - least for p in got) == pytest.approx(best(list(range(n))))


def test_abstaining_takes_many_frames_at_once_and_ties_go_to_the_smaller(spark):
    rows = [(f, f"g{i}", f"p{j}", s) for f in range(30) for i, j, s in ((0, 0, 0.6), (1, 0, 0.6), (2, 1, 0.9), (2, 2, 0.4), (3, 3, 0.3), (4, 4, None))]
    out = A.assign_or_abstain(spark.createDataFrame(rows, "frame int, g string, p string, s double"), "frame", "g", "p", "s", 0.47, 0.05)
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(f, *x) for f in range(30) for x in (("g0", "p0", 0.6, True), ("g2", "p1", 0.9, False))]


def test_suppression_takes_many_frames_at_once_and_unknown_boxes_stay(spark):
    nan = float("nan")
    few = [(f, *x) for f in range(30) for x in (("a", 0.0, 0.0, 10.0, 10.0, 0.9), ("b", 1.0, 0.0, 10.0, 10.0, 0.9), ("c", 20.0, 0.0, 10.0, 10.0, 0.2), ("d", nan, 0.0, 10.0, 10.0, 0.8), ("e", 0.0, None, 10.0, 10.0, nan))]
    rnd = random.Random(1)
    many = [(100, f"m{i}", rnd.random() * 40, rnd.random() * 40, 10.0, 10.0, rnd.random()) for i in range(200)]
    boxes = lambda rows: spark.createDataFrame(rows, "frame int, id string, x double, y double, w double, h double, score double")
    out = A.suppress(boxes(few + many), "frame", 0.5)
    assert "FlatMapGroupsInPandas" not in plan(out)
    got = sorted((r["frame"], r["id"]) for r in out.collect())
    assert got[:120] == [(f, i) for f in range(30) for i in "acde"]
    kept = []
    for _, i, x, y, w, h, _ in sorted(many, key=lambda r: -r[6]):
        inter = lambda k: max(0.0, min(x, k[1]) + 10 - max(x, k[1])) * max(0.0, min(y, k[2]) + 10 - max(y, k[2]))
        if not any(inter(k) / (200 - inter(k)) > 0.5 for k in kept):
            kept.append((i, x, y))
    assert got[120:] == sorted((100, k[0]) for k in kept)


def test_successors_take_many_frames_at_once_and_ties_go_to_the_smaller(spark):
    rows = [(f, f"g{i}", f"p{j}", s) for f in range(30) for i, j, s in ((0, 0, 0.6), (1, 0, 0.6), (2, 1, 0.3), (2, 2, None))]
    out = A.successors(spark.createDataFrame(rows, "frame int, g string, p string, s double"), "frame", "g", "p", "s", 0.47)
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:3]) == [(f, *x) for f in range(30) for x in (("g0", "p0", 0.6, True), ("g1", "p0", 0.6, False), ("g2", "p1", 0.3, False), ("g2", "p2", None, False))]


def test_precision_recall_has_no_frame_that_is_counted_anew_for_every_row(spark):
    rows = [(i, i % 3 == 0, float(i * 7919 % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, truth boolean, score double").withColumn("truth", F.col("truth").cast("int"))
    out = Q.precision_recall(df)
    assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan(out))
    got = out.orderBy("rank").collect()
    best = 0.0
    for r in reversed(got):
        best = max(best, r["tp"] / r["rank"])
        assert r["envelope"] == best


def test_detection_average_precision_counts_no_frame_anew_for_every_row(spark):
    boxes = spark.createDataFrame([(f, f"{s}{i}", s, 1.0 / (1 + f + i)) for f in range(40) for s in ("gt", "pred") for i in range(2)], "frame int, id string, side string, score double")
    pairs = spark.createDataFrame([(f, "gt0", "pred0", 1.0 / (1 + f), 0.9) for f in range(40)], "frame int, g_id string, p_id string, score double, iou double")
    out = Q.detection_average_precision(boxes, pairs)
    assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan(out))
    assert tuple(out.first())[1:] == (80, 80, 40)


def vectors(spark, n=90, keys=3, odd=True):
    rnd = random.Random(5)
    rows = [(i, i % keys if i % 10 else None, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    rows = [(i, k, v if i % 17 else rows[0][2]) for i, k, v in rows]  # copies
    rows += [(n, 0, None), (n + 1, 0, [1.0, 2.0]), (n + 2, 1, [float("nan")] * 4), (n + 3, 2, [1.0, None, 1.0, 1.0])] if odd else []
    return spark.createDataFrame(rows, "id long, person int, v array<double>")


def all_pairs(v):
    a, b = v.select("person", F.col("id").alias("pred"), F.col("v").alias("va")), v.select("person", F.col("id").alias("succ"), F.col("v").alias("vb"))
    return a.join(b, "person").where("pred < succ").select("person", "pred", "succ", dot("va", "vb").alias("sim"))


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("block", [7, 4096])
def test_similar_pairs_equal_the_join(spark, block):
    v = vectors(spark)
    got = B.similar_pairs(v, "person", 0.5, block)
    assert rows_of(got) == rows_of(all_pairs(v).where("sim > 0.5"))
    assert rows_of(got)


def test_components_compare_vectors_by_blocks(spark):
    from strandline.plans import join_queries

    asked = []
    found = B.similar_pairs

    def noted(*args):
        asked.append(args[1:])
        return found(*args)

    B.similar_pairs = noted
    try:
        assert join_queries.components_minlabel(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        B.similar_pairs = found
    assert asked == [("person", 0.33)]


@pytest.mark.parametrize("block", [7, 4096])
def test_strongest_pairs_decide_the_mutual_best(spark, block):
    v = vectors(spark)
    best = lambda pairs: rows_of(A.mutual_best(pairs.withColumn("sim", F.round("sim", 6)), "person", "pred", "succ", "sim", 0.02))
    strong = B.strongest_pairs(v, "person", block=block)
    assert best(strong) == best(all_pairs(v))
    assert strong.count() < all_pairs(v).count()


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_equals_the_least_of_all_pairs(spark, block):
    v = vectors(spark)
    p = all_pairs(v).withColumn("d", F.greatest(F.lit(0.0), 1 - F.col("sim")))
    both = p.select("person", F.col("pred").alias("id"), "d").unionByName(p.select("person", F.col("succ").alias("id"), "d"))
    shown = lambda df: rows_of(df.select("person", "id", F.round("d", 9).alias("d")))
    assert shown(B.nearest(v, "person", block)) == shown(both.groupBy("person", "id").agg(F.min("d").alias("d")))


@pytest.mark.parametrize("block", [7, 4096])
def test_demoted_pairs_equal_demotion_of_all_edges(spark, block):
    v = vectors(spark, n=60)
    v = v.where("person is not null and not isnan(v[0])")
    e = all_pairs(v).where("sim > 0.2").select("pred", "succ", F.round("sim", 6).alias("score"), F.when(F.col("sim") > 0.9, "accepted").otherwise("review").alias("state"))
    got = rows_of(B.demoted_pairs(v, "person", 0.2, 0.9, block=block))
    assert got == rows_of(G.demote_ambiguous(e))
    assert {r.split("state=")[1] for r in got} == {"'accepted')", "'review')"}


def test_cosine_pairs_are_compared_by_blocks(spark):
    from strandline.plans import join_queries

    assert "MapInArrow" in plan(join_queries.cosine_pairs(spark, "/root/testdata/sf0.001"))


def test_veto_components_stream_their_edges(spark):
    rnd = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    nodes = [(s, n, rnd.choice([None, "a", "b"]), rnd.choice([None, None, 1, 2])) for s in ("x", "y") for n in names]
    edges = [(s, *rnd.sample(names, 2), rnd.choice([0.5, 0.6, rnd.random()])) for s in ("x", "y") for _ in range(150)]
    out = G.components_with_veto(spark.createDataFrame(edges, "scene string, pred string, succ string, score double"), spark.createDataFrame([*nodes, ("z", "n00", "a", None)], "scene string, node string, team string, shirt int"), "scene", ["team", "shirt"])
    assert "CoGroup" not in plan(out)
    want = {("z", "n00", "n00")}
    for s in ("x", "y"):
        group = {n: ({n}, {t} - {None}, {h} - {None}) for k, n, t, h in nodes if k == s}
        for _, p, q, _ in sorted((e for e in edges if e[0] == s), key=lambda e: (-e[3], e[1], e[2])):
            a, b = group[p], group[q]
            if a is not b and len(a[1] | b[1]) < 2 and len(a[2] | b[2]) < 2:
                both = (a[0] | b[0], a[1] | b[1], a[2] | b[2])
                group |= {n: both for n in both[0]}
        want |= {(s, n, min(group[n][0])) for n in group}
    assert set(map(tuple, out.collect())) == want


def test_number_candidates_join_the_first_of_each_team_only(spark):
    people = [(i, i % 3, (None, "a", "b")[i % 7 % 3], i % 4 / 4, True) for i in range(20)]
    roster = [(p, f"N{p * 37 % 100}", p % 3, (None, "a", "b", "c")[p % 4]) for p in range(300)]
    out = I.number_candidates(spark.createDataFrame(people, "subject int, number int, team string, confidence double, reliable boolean"), spark.createDataFrame(roster, "player int, name string, number int, team string"), 4)
    assert len(re.findall("row_number", plan(out).split("== Optimized")[0].split("== Analyzed")[1])) > 1
    want = set()
    for s, number, team, conf, _ in people:
        scored = [(-conf * (0.9 if team is None or t is None else 1.0 if t == team else 0.5), name.lower(), p) for p, name, n, t in roster if n == number]
        want |= {(s, p, -v, k + 1) for k, (v, _, p) in enumerate(sorted(scored)[:4])}
    assert set(map(tuple, out.collect())) == want


@pytest.mark.parametrize("block", [16, 32_768])
def test_pair_distances_are_counted_by_task(spark, block):
    v = vectors(spark, odd=False)
    out = Q.pair_distances(v, block)
    assert "FlatMapGroupsInPandas" not in plan(out)
    rows = [(r["id"], r["person"], r["v"]) for r in v.collect()]
    want = {}
    for (i, p, x), (j, q, y) in itertools.combinations(rows, 2):
        at = (None if p is None or q is None else p == q, round(min(2.0, max(0.0, 1 - sum(a * b for a, b in zip(x, y)))), 6))
        want[at] = want.get(at, 0) + 1
    got = {(r["same"], round(r["d"], 6)): r["n"] for r in out.collect()}
    assert got == want


def test_few_keys_with_many_pairs_are_dealt_to_many_tasks(spark):
    a = spark.createDataFrame([(i, i % 3 or None) for i in range(20)], "a int, ka int")
    b = spark.createDataFrame([(i, i % 3 or None) for i in range(500)], "b int, kb int").coalesce(1)
    out = J.spread_join(a, b, {"ka": "kb"}, "b")
    assert rows_of(out) == rows_of(a.join(b, F.col("ka") == F.col("kb")))
    assert len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}) > 8


def test_plain_pairs_of_the_tracker_are_costed_as_one_matrix(monkeypatch):
    rnd = random.Random(2)
    rule = K.TrackerConfig()
    none = np.zeros(0)
    see = lambda i, **more: SimpleNamespace(**{"x": rnd.random() * 300, "y": rnd.random() * 90, "height": 30 + 20 * rnd.random(), "v": np.array([rnd.random(), 0.5]) if i % 4 else none, "pitch_x": np.nan, "pitch_z": np.nan, "uncertainty": 0.0, "reid_unit": none, "claims": K.Claims(), "mark": None, **more})
    start = lambda i, d: K._Track(i, 0.1 * (i % 8), d.x, d.y, d.height, d.v, d.pitch_x, d.pitch_z, 0.0, d.claims, d.mark, vx=rnd.random() * 50)
    tracks, dets = [start(i, see(i)) for i in range(30)], [see(i) for i in range(25)]
    claimed = see(1, claims=K.Claims(team="a"))
    want = [[K._cost(k, d, 0.7, rule) for d in [*dets, claimed]] for k in tracks]
    asked = []
    monkeypatch.setattr(K, "_cost", lambda *a: asked.append(a))
    got = K._costs(tracks, [*dets, claimed], 0.7, rule)
    assert not asked and np.isfinite(got).any() and not np.isfinite(got).all()
    np.testing.assert_allclose(got, want, rtol=1e-12)
