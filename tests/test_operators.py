"""Operators on small inline rows, against brute force or values worked out by hand."""

import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.functions import geometry, numeric, text
from strandline.operators import assign, fuse, graph, joins, quality, records, scoring, series, solve
from strandline.sources import artifacts


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_hungarian_is_optimal(n, m, rnd):
    cost = np.array([[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)], dtype=float)
    got = assign.hungarian(cost)
    assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    if n <= m:
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    else:
        best = min(sum(cost[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
    assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_optimal_beats_greedy(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85)], "frame int, g string, p string, iou double")
    assert assign.greedy_matches(pairs, "frame", "g", "p", "iou").count() == 1
    assert {(r["g"], r["p"]) for r in assign.optimal_matches(pairs, "frame", "g", "p", "iou").collect()} == {("a", "y"), ("b", "x")}


def test_abstaining_and_ambiguity(spark):
    edges = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.88), (1, "c", "y", 0.3), (1, "d", "z", 0.95)], "k int, a string, b string, s double")
    got = {r["a"]: (r["b"], r["ambiguous"]) for r in assign.assign_or_abstain(edges, "k", "a", "b", "s", 0.47, 0.05).collect()}
    assert got == {"a": ("x", True), "d": ("z", False)}


def test_suppression(spark):
    rows = [(1, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "b", 1.0, 0.0, 10.0, 10.0, 0.8), (1, "c", 50.0, 0.0, 10.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "f int, id string, x double, y double, w double, h double, score double")
    assert {r["id"] for r in assign.suppress(df, "f", 0.5).collect()} == {"a", "c"}


def test_veto_components(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "c", 0.8), (1, "c", "d", 0.7)], "s int, pred string, succ string, score double")
    nodes = spark.createDataFrame([(1, "a", 7), (1, "b", None), (1, "c", 9), (1, "d", None), (2, "e", 1)], "s int, node string, shirt int")
    got = {r["node"]: r["component"] for r in graph.components_with_veto(edges, nodes, "s", ["shirt"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_components_and_terminals(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a int, b int")
    got = {r["node"]: r["component"] for r in graph.components(chain, "a", "b").collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 4)], "source int, target int")
    assert {tuple(r) for r in graph.terminal_targets(spark, merges).collect()} == {(1, 4), (2, 4), (3, 4), (7, 4)}
    with pytest.raises(ValueError):
        graph.terminal_targets(spark, spark.createDataFrame([(1, 2), (2, 1)], "source int, target int"))


def test_ambiguity_demotes_all_near_the_best(spark):
    rows = [("a", "x", 0.90, "accepted"), ("a", "y", 0.85, "accepted"), ("a", "z", 0.5, "accepted"), ("b", "w", 0.9, "accepted")]
    got = {(r["pred"], r["succ"]): r["state"] for r in graph.demote_ambiguous(spark.createDataFrame(rows, "pred string, succ string, score double, state string")).collect()}
    assert got == {("a", "x"): "review", ("a", "y"): "review", ("a", "z"): "accepted", ("b", "w"): "accepted"}


def test_time_warping():
    a = np.sin(np.linspace(0, 6, 24))
    assert solve.warp(a, a)[0] == 0
    assert solve.warp(a, np.interp(np.linspace(0, 23, 30), np.arange(24), a))[0] < 0.07  # the limit up to which passes overlap
    assert solve.warp(a, np.ones(24))[0] > 0.07 and solve.warp(a[:1], a)[0] == 1


def test_best_path_prefers_the_plausible():
    times = [0.0, 0.1, 0.2, 0.3]
    frames = [[(0, 0, 0.6)], [(1, 0, 0.5), (60, 30, 0.95)], [(2, 0, 0.5)], [(3, 0, 0.6), (-50, 0, 0.9)]]
    assert solve.best_path(times, frames, solve.PathConfig()) == [0, 0, 0, 0]
    assert solve.best_path([0.0, 0.1], [[], [(0, 0, 0.5)]], solve.PathConfig()) == [None, None]


def test_paths_need_rising_times(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1, 0.0, 0.0, 0.5), (1, 1, 0.5, 2, 0.0, 0.0, 0.5)], "s int, frame bigint, t double, id bigint, x double, z double, conf double")
    with pytest.raises(PySparkException):
        solve.solve_paths(df, "s").collect()


def test_homography(spark):
    h = np.array([[1.2, 0.1, 3], [-0.05, 0.9, 2], [0.001, 0.002, 1]])
    src = np.array([[0, 0], [10, 0], [0, 10], [10, 12], [5, 3]], float)
    p = np.c_[src, np.ones(5)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    assert np.allclose(solve.fit_homography(src, dst), h, atol=1e-8)
    df = spark.createDataFrame([(src.tolist(), dst.tolist(), h.reshape(-1).tolist())], "s array<array<double>>, d array<array<double>>, h array<double>")
    r = df.select(solve.homography("s", "d").alias("f"), geometry.project(F.col("h"), F.lit(5.0), F.lit(3.0)).alias("p"), geometry.multiply(F.col("h"), geometry.inverse(F.col("h"))).alias("i")).first()
    assert np.allclose(r["f"], h.reshape(-1), atol=1e-8) and np.allclose([r["p"]["x"], r["p"]["y"]], dst[4]) and np.allclose(r["i"], np.eye(3).reshape(-1), atol=1e-9)


def test_identity_scores(spark):
    def score(rows):
        df = spark.createDataFrame(rows, "seq int, t double, gt string, pred string")
        return quality.identity_f1(df).first()

    assert score([(1, float(t), "a", "p") for t in range(4)])["idf1"] == 1
    r = score([(1, 0.0, "a", "p"), (1, 1.0, "a", "q"), (1, 0.0, "b", "q"), (1, 1.0, "b", "p"), (1, 2.0, None, None)])
    assert (r["idtp"], r["idfp"], r["idfn"]) == (2, 2, 2)
    assert score([(1, 0.0, "a", "p"), (1, 0.0, "a", "q")])["status"] == "invalid"


def test_average_precision(spark):
    rows = [(i, int(t), float(10000 - 700 * i)) for i, t in enumerate([1, 0, 1, 1, 0])]
    got = quality.average_precision(spark.createDataFrame(rows, "id int, truth int, score double")).first()
    assert got["average_precision"] == pytest.approx((1 + 0.75 + 0.75) / 3)
    assert quality.average_precision(spark.createDataFrame([(1, 0, 1.0)], "id int, truth int, score double")).first()["average_precision"] is None


def test_gates(spark):
    v = spark.createDataFrame([(0.5, None)], "a double, b double")
    got = {r["gate"]: r["verdict"] for r in quality.gates(v, [("x", "a", True, 0.5, 0.2), ("y", "a", False, 0.1, 0.2), ("z", "b", True, 1.0, 0.5)]).collect()}
    assert got == {"x": "pass", "y": "reject", "z": "unknown"}
    worst = lambda *s: spark.range(1).select(quality.worst_verdict(F.array(*map(F.lit, s)))).first()[0]
    assert (worst("pass", "unknown"), worst("pass", "pass"), worst("review", "reject")) == ("review", "pass", "reject")


def test_intervals(spark):
    rows = [("o", 1, 0.0, 10.0), ("o", 2, 5.0, 5.0), ("o", 3, 10.0, 12.0), ("o", 4, 5.0, 5.0), ("o", 5, 70.0, 71.0), ("p", 6, 0.0, 99.0)]
    df = spark.createDataFrame(rows, "owner string, id int, s double, e double")
    assert {(r["id_a"], r["id_b"]) for r in joins.interval_pairs(df).collect()} == {(1, 2), (1, 4), (2, 4)}
    assert [(r["s"], r["e"]) for r in joins.interval_union(df).where("owner = 'o'").orderBy("s").collect()] == [(0, 12), (70, 71)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=12))
def test_asof_against_brute_force(spark, left, right):
    a = [(i, k, t / 10) for i, (k, t) in enumerate(left)]
    b = [(i, k, t / 10) for i, (k, t) in enumerate(right)]
    schema = "id int, k int, t double"
    got = {r["id"]: r["match_id"] for r in joins.asof_nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", 0.5).collect()}
    for i, k, t in a:
        near = sorted((abs(t - u), u, j) for j, m, u in b if m == k and abs(t - u) <= 0.5)
        assert got[i] == (near[0][2] if near else None)


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "P", 0.0, 0.0), (2, "O", 5.0, 0.0), (3, "O", 50.0, 0.0), (4, "P", 0.0, 0.0), (5, "F", 0.0, 0.0), (6, "O", 1.0, 0.0)], "id int, status string, available double, requested double")
    leases = spark.createDataFrame([(1, 20.0), (4, 10.0), (6, 10.5)], "job_id int, expires double")
    assert {r["id"] for r in joins.runnable_jobs(jobs, leases, ["P", "O"], "P", 10.0).collect()} == {2, 4}
    assert {r["id"] for r in joins.live_claims(jobs, leases, 10.0).collect()} == {1, 6}
    with pytest.raises(PySparkException):
        joins.require_known(leases, "job_id", jobs.where("id < 5"), "id").collect()


def test_votes(spark):
    rows = [("a", 9, 0.9), ("a", 9, 0.95), ("a", 4, 0.3), ("b", 1, 0.9), ("b", 2, 0.89), ("c", 3, 0.9)]
    got = {r["tracklet"]: (r["number"], r["state"]) for r in fuse.votes(spark.createDataFrame(rows, "tracklet string, number int, conf double")).collect()}
    assert got == {"a": (9, "reliable"), "b": (1, "conflict"), "c": (3, "provisional")}


def test_debounce_and_letters(spark):
    df = spark.createDataFrame([("a", t) for t in (1.0, 1.1, 1.2, 5.0, 5.1)], "owner string, t double")
    got = series.cuts_to_segments(df, 0.0, 10.0, 0.15, 2.5).orderBy("s").collect()
    assert [(r["s"], r["e"]) for r in got] == [(1.2, 5.0), (5.0, 10.0)]
    assert [r[0] for r in spark.range(1, 30).select(series.variant_letters(F.col("id"))).collect()][25:28] == ["Z", "AA", "AB"]


def test_text_and_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.shirt_number(F.lit(" 08 "))) == "8" and one(text.shirt_number(F.lit("100"))) is None
    assert one(text.digit_runs(F.lit("a1 22 333 4"))) == ["1", "22", "4"]
    assert one(text.clock_label(F.lit(45), F.lit(2))) == "45+2'" and one(text.clock_label(F.lit(7), F.lit(None).cast("int"))) == "7'"
    assert one(text.slug(F.lit("  Été & Co. "))) == "t-co"
    assert one(text.folded_name(F.lit("Müller-Ñandú"))) == "mullernandu"
    assert one(numeric.finite(F.lit("nan"))) is None and one(numeric.finite(F.lit("1e3"))) == 1000
    assert one(numeric.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert one(numeric.f1(F.lit(0.0), F.lit(0.0))) == 0
    assert one(text.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_scoring(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    no = F.lit(None).cast("boolean")
    edge = lambda **k: one(scoring.identity_edge(**({"gap": F.lit(1.0), "distance": F.lit(3.0), "uncertainty": F.lit(0.0), "external": no, "shirt": no, "shirt_confidence": F.lit(None).cast("double"), "reid": F.lit(None).cast("double"), "soft_conflicts": F.lit(0)} | k)))
    assert edge(gap=F.lit(-1.0))["state"] == "rejected" and edge(distance=F.lit(99.0))["reasons"] == ["unreachable"]
    assert edge(external=F.lit(True))["state"] == "accepted"
    assert edge(reid=F.lit(0.3))["state"] == "review"
    assert edge(shirt=F.lit(False), shirt_confidence=F.lit(0.9))["reasons"] == ["shirt"]
    assert one(scoring.calibration_uncertainty(F.lit(None).cast("double"), F.lit(0.5))) == 5.0
    assert one(scoring.pass_quality(F.lit("reject"), F.lit(1.0), F.lit(1.0), F.lit(14), F.lit(18), F.lit(30))) == 0.24


def test_records(spark):
    bundle = spark.createDataFrame([("m", [("t1", [("p1", "A", "1"), ("p2", "B", "2")], [("p1", "again", "9"), ("p3", "C", "2")])])], "match_id string, lineups array<struct<team:string,starters:array<struct<id:string,name:string,number:string>>,substitutes:array<struct<id:string,name:string,number:string>>>>")
    rows = records.lineup(bundle)
    assert {(r["player_id"], r["role"]) for r in rows.collect()} == {("p1", "starter"), ("p2", "starter"), ("p3", "substitute")}
    assert records.shirt_conflicts(rows).first()["number"] == "2"
    current = spark.createDataFrame([("a", 3)], "k string, revision int")
    writes = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 3, 2), ("b", 4, 0)], "k string, write_id int, expected int")
    assert {tuple(r) for r in records.compare_and_set(current, writes, "k").collect()} == {("a", 1, 4), ("b", 4, 1)}


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, name string")
    made = artifacts.put(rows, "points", path).collect()
    artifacts.put(rows, "points", path)
    stored = artifacts.stored_records(spark, path)
    assert stored.count() == len(made) == 2
    digest = made[0]["digest"]
    assert artifacts.fetch(spark, path, [digest]).count() == 1
    spark.createDataFrame([("points", "ab" * 32, "{}", "ab")], artifacts.RECORD).write.mode("append").partitionBy("prefix").parquet(path)
    with pytest.raises(PySparkException):
        artifacts.fetch(spark, path, ["ab" * 32]).collect()
    assert [r["body"] for r in artifacts.fetch(spark, path, [digest]).collect()] == [made[0]["body"]]
    with pytest.raises(PySparkException, match="absent record cd"):
        artifacts.fetch(spark, path, [digest, "cd" * 32]).collect()
    frames = spark.createDataFrame([("s", i, i / 25) for i in range(26)], "scene string, frame int, t double")
    got = artifacts.sampled_frames(frames, "scene", 10.0).orderBy("tick").collect()
    assert [r["tick"] for r in got] == list(range(11)) and got[1]["frame"] in (2, 3)


def test_lineage(spark):
    from strandline.operators import lineage

    schema = "id int, frame int, x double, y double, w double, h double"
    seen = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 20.0), (2, 1, 100.0, 0.0, 10.0, 20.0), (3, 2, 0.0, 0.0, 10.0, 20.0)], schema)
    one = spark.createDataFrame([(9, 1, 1.0, 1.0, 10.0, 20.0)], schema)
    assert [tuple(r) for r in lineage.resolve_unique(one, seen).collect()] == [(9, 1)]
    with pytest.raises(PySparkException):
        lineage.resolve_unique(spark.createDataFrame([(9, 1, 50.0, 1.0, 10.0, 20.0)], schema), seen).collect()
    log = spark.createDataFrame([("a", 1, "t1", None), ("a", 2, None, "keeper"), ("a", 3, "t2", None)], "track string, updated int, team string, role string")
    assert [tuple(r) for r in lineage.latest_manual(log, "track").collect()] == [("a", "t2", "keeper")]
    shift = lambda d: [1.0, 0.0, d, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    edges = spark.createDataFrame([("s", 0, shift(1.0)), ("s", 1, shift(2.0)), ("s", 3, shift(4.0))], "scene string, at int, h array<double>")
    targets = spark.createDataFrame([(1, "s", 0, 2), (2, "s", 0, 4)], "id int, scene string, start int, stop int")
    got = {r["id"]: r["h"] for r in lineage.motion_chain(targets, edges, "scene").collect()}
    assert got[1][2] == 3.0 and got[2] is None


def test_tracker(spark):
    from strandline.operators import tracking

    rows = []
    for k in range(8):  # two that cross, told apart by how they look; one weak detection alone
        rows += [("s", 10 * k, k * 0.1, 100.0 + 20 * k, 50.0, 40.0, 0.9, [1.0, 0.0]), ("s", 10 * k + 1, k * 0.1, 240.0 - 20 * k, 50.0, 40.0, 0.9, [0.0, 1.0])]
    rows += [("s", 500, 0.3, 900.0, 900.0, 40.0, 0.05, [0.5, 0.5]), ("s", 600, 3.0, 240.0, 50.0, 40.0, 0.9, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "scene string, det_id int, t double, x double, y double, height double, confidence double, feature array<double>, pitch_x double, pitch_z double, uncertainty double")
    got = {r["det_id"]: r["track"] for r in tracking.track(df, "scene").collect()}
    assert len({got[10 * k] for k in range(8)}) == 1 and len({got[10 * k + 1] for k in range(8)}) == 1
    assert got[0] != got[1] and got[500] == -1 and got[600] not in (got[0], got[1])


def test_confirmed_changes(spark):
    from strandline.operators import tracking

    df = spark.createDataFrame([("a", float(t), s) for t, s in enumerate("xxyxyyyxx")], "k string, t double, state string")
    assert sorted(r["t"] for r in tracking.confirmed_changes(df, "k").collect()) == [4.0, 7.0]


def test_match_records(spark):
    from strandline.operators import matchdata

    players = [("m", f"p{i}", f"t{i % 2}", "G" if i < 2 else "D", str(i // 2), "starter") for i in range(22)]
    schema = "match_id string, id string, team_id string, position string, number string, lineup_role string"
    timeline = spark.createDataFrame([("m", "p1", None)], "match_id string, player_id string, secondary_player_id string")
    subs = spark.createDataFrame([("m", "p1", "p2")], "match_id string, player_out_id string, player_in_id string")
    good = spark.createDataFrame(players, schema)
    assert matchdata.bundle_problems(good, timeline, subs).count() == 0
    q = matchdata.roster_quality(good).first()
    assert (q["teams"], q["starters"], q["keepers"], q["numbered"]) == (2, 22, 2, 22)
    bad = spark.createDataFrame(players[:21] + [players[0], ("m", "p30", "t0", "D", "0", "substitute")], schema)
    lost = spark.createDataFrame([("m", "nobody", "p1")], "match_id string, player_id string, secondary_player_id string")
    got = {(r["problem"], r["detail"]) for r in matchdata.bundle_problems(bad, lost, subs).collect()}
    assert got == {("duplicate-player", "p0"), ("duplicate-number", "t0:0"), ("few-starters", "t1"), ("unknown-player_id", "nobody")}
    raw = spark.createDataFrame([("x", "1", "2026-07-10T19:00:00+00:00", "FT", "L", 2026, "A", "B", 2, 1)], "provider string, id string, kickoff string, status string, league string, season int, home string, away string, home_score int, away_score int")
    r = matchdata.fixtures(raw).first()
    assert (r["date"], r["time"], r["status"], r["name"]) == ("2026-07-10", "19:00", "ft", "A - B")
    acts = spark.createDataFrame([("p", 1, 0.0, 5.0, "auto", "confirmed", 0.9), ("p", 2, 2.0, 4.0, "manual", "draft", 0.1), ("p", 3, 0.0, 9.0, "manual", "rejected", 1.0)], "who string, id int, start double, stop double, source string, status string, confidence double")
    assert matchdata.active_action(acts, "who", F.lit(4.0)).first()["id"] == 2
    assert matchdata.active_action(acts, "who", F.lit(5.0)).first()["id"] == 1


def test_temporal(spark):
    from strandline.operators import temporal

    move = lambda d: [1.0, 0.0, d, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    frames = spark.createDataFrame([("s", 1, 0.1), ("s", 2, 0.2), ("s", 6, 0.6)], "scene string, sample int, t double")
    anchors = spark.createDataFrame([("s", 0, 0.0, move(0.0), 0.95, 1.0, 0.5), ("s", 3, 0.3, move(-3.0), 0.95, 1.0, 0.5)], "scene string, sample int, t double, h array<double>, confidence double, inlier_ratio double, uncertainty double")
    edges = spark.createDataFrame([("s", k, move(-1.0), move(1.0), 0.9, 1.0, k != 4) for k in range(6)], "scene string, at int, h array<double>, back array<double>, confidence double, residual double, reliable boolean")
    found = temporal.hypotheses(frames, anchors, edges)
    # Both anchors put the frame at the same place; none reaches sample 6 over the unreliable edge.
    assert {(r["sample"], r["anchor"], r["h"][2]) for r in found.collect()} == {(1, 0, -1.0), (1, 3, -1.0), (2, 0, -2.0), (2, 3, -2.0)}
    got = {r["sample"]: r for r in temporal.propagate(found).collect()}
    assert got[1]["state"] == got[2]["state"] == "accepted" and got[1]["anchor"] == 0 and got[1]["uncertainty"] < 1
    a = spark.createDataFrame([("s", i, i * 0.4, r, m) for i, (r, m) in enumerate([(1.0, False), (9.0, False), (1.0, False), (8.0, True), (1.2, False)])], "scene string, id int, t double, residual double, manual boolean")
    assert {r["id"] for r in temporal.demote_outliers(a, "scene", 2.0, 2.0, 0.5).collect() if r["demoted"]} == {1}
    k = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 1.0, 1.0, 1.0)], "who string, id int, t double, x double, z double")
    e = spark.createDataFrame([("a", 1.05, 5.0, 5.0), ("a", 0.5, 7.0, 7.0)], "who string, t double, x double, z double")
    assert {(r["id"], r["x"]) for r in temporal.upsert_keyframe(k, e, "who").collect()} == {(1, 0.0), (2, 5.0), (None, 7.0)}


def test_long_chains_and_all_pairs(spark):
    merges = spark.createDataFrame([(i, i + 1) for i in range(300)], "source int, target int")
    assert {tuple(r) for r in graph.terminal_targets(spark, merges).collect()} == {(i, 300) for i in range(300)}
    x = np.random.default_rng(2).normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(40)], "id bigint, person int, v array<double>")
    got = {(r["same"], round(r["d"], 6)): r["n"] for r in quality.pair_distances(v, 9).collect()}
    want = Counter((i % 3 == j % 3, round(min(2.0, max(0.0, 1 - float(x[i] @ x[j]))), 6)) for i in range(40) for j in range(i + 1, 40))
    assert got == want


def test_whole_track_is_warped(spark):
    rows = [(1, float(t), 0.0 if t < 30 else 1.0) for t in range(60)] + [(2, float(t), 0.0) for t in range(60)] + [(3, 5.0, 0.5)]
    got = {r["k"]: r["v"] for r in solve.resampled(spark.createDataFrame(rows, "k int, t double, conf double"), "k", "conf", 24).collect()}
    assert len(got[1]) == 24 and got[1][0] == 0 and got[1][-1] == 1 and got[2] == [0.0] * 24 and got[3] == [0.5]
    assert solve.warp(got[1], got[2])[0] > 0.1


def test_candidate_paths_use_the_whole_search(spark, monkeypatch):
    from strandline.plans import record_queries

    seen = []
    monkeypatch.setattr(solve, "solve_paths", lambda rows, key, config=solve.PathConfig(): seen.append(config))
    record_queries.best_candidate_paths(spark, "/root/testdata/sf0.001")
    assert seen == [solve.PathConfig()] and (seen[0].top, seen[0].beam) == (6, 128)
