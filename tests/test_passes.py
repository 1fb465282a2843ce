"""Replays, fused passes and greedy matching against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import passes as M
from strandline.operators import quality as Q


def warping(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i, j] = abs(x - y) + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return best[-1, -1] / (len(a) + len(b))


def test_replays_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    rows = []
    for owner in range(6):
        shapes = [np.cumsum(r.normal(size=12)) / 4 for _ in range(3)]
        for i in range(12):
            v = shapes[int(r.integers(0, 3))] + r.normal(size=12) * float(r.choice([0.02, 0.2, 0.5]))
            v = np.repeat(v, r.integers(1, 3, size=12)).tolist()
            rows.append((owner, int(r.integers(0, 2)), owner * 100 + i, int(r.integers(0, 9)), None if i == 5 else [] if i == 6 else [*v, float("nan")] if i == 7 else v))
    table = spark.createDataFrame(rows, "owner bigint, grp bigint, id bigint, start bigint, v array<double>")
    got = {x["id"]: x for x in M.replays(table).collect()}
    roles = set()
    for owner in range(6):
        for grp in (0, 1):
            mine = sorted((x for x in rows if x[:2] == (owner, grp)), key=lambda x: (x[3], x[2]))
            for k, x in enumerate(mine):
                usable = lambda v: bool(v) and not np.isnan(v).any()
                costs = [warping(x[4], y[4]) for y in mine[:k] if usable(x[4]) and usable(y[4])]
                role = "original" if k == 0 else "replay" if costs and min(costs) <= 0.095 else "continuation"
                assert (got[x[2]]["variant"], got[x[2]]["role"]) == (k, role)
                if role == "replay":
                    assert got[x[2]]["cost"] == pytest.approx(min(costs)) and got[x[2]]["confidence"] == pytest.approx(max(0.55, min(0.95, 1 - min(costs) / 0.16)), abs=1e-3)
                roles.add(role)
    assert roles == {"original", "replay", "continuation"}


def test_the_bound_is_below_every_warping(spark):
    r = np.random.default_rng(6)
    pairs = [(r.normal(size=int(r.integers(1, 9))).tolist(), (r.normal(size=int(r.integers(1, 9))) + float(r.choice([0, 2]))).tolist()) for _ in range(300)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i bigint, a array<double>, b array<double>").select("i", M.least_warp(F.col("a"), F.col("b")).alias("low")).collect()
    lows = {x["i"]: x["low"] for x in got}
    assert all(lows[i] <= warping(*p) + 1e-9 for i, p in enumerate(pairs)) and sum(lows[i] > 0.2 for i in lows) > 100


PEOPLE = "match bigint, pass string, id bigint, team string, role string, external string, number string, conflict boolean"
PASSES = "match bigint, pass string, seq int, quality double, overlap boolean, confidence double, manual boolean, anchors int"


def test_people_are_linked_to_the_reference_pass(spark):
    passes = [(1, "a", 0, 0.5, True, 0.9, False, 3), (1, "b", 1, 0.8, True, 0.9, False, 3), (1, "c", 2, 0.8, True, 0.7, False, 2), (1, "d", 3, None, True, 0.6, False, 3), (1, "e", 4, 0.1, True, 0.5, True, 2)]
    people = [
        (1, "b", 1, "x", None, "p1", "9", None), (1, "b", 2, "x", None, None, "7", False), (1, "b", 3, "y", None, None, "7", False), (1, "b", 4, "y", "keeper", None, "1", True), (1, "b", 5, None, None, None, "5", False),
        (1, "a", 11, None, None, "p1", None, False), (1, "a", 12, "x", None, None, "7", False), (1, "a", 13, None, None, None, "7", False), (1, "a", 14, None, None, None, "1", False), (1, "a", 15, None, None, "p9", "5", False), (1, "a", 16, None, None, None, None, False),
        (1, "c", 21, None, None, "p1", "8", False), (1, "c", 22, "y", None, None, "7", False), (1, "d", 31, None, None, "p1", None, False), (1, "e", 41, None, None, None, "5", None),
    ]
    got = {r["id"]: r for r in M.fuse_passes(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(passes, PASSES)).collect()}
    assert len(got) == len(people) and {r["state"] for i, r in got.items() if i < 10} == {"reference"}  # b: the first of the best
    assert (got[11]["fused"], got[11]["state"], got[11]["score"]) == ("1", "linked", 1.0)
    # Shirt 7 is worn by two of the reference: 12's team tells, 13's does not; then 2 has two claims and neither is clear.
    assert got[12]["state"] == got[13]["state"] == "review"
    assert got[14]["state"] == "alone"  # its counterpart has a conflict
    assert got[15]["state"] == "alone" and got[16]["state"] == "alone"  # bound against unbound; nothing known
    assert got[21]["state"] == "alone" and got[22]["fused"] == "3" and got[31]["state"] == "unaligned" and got[41]["fused"] == "5"
    assert got[16]["fused"].startswith("angle-") and got[16]["fused"].endswith(":person:16")
    done = M.finalized(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(passes, PASSES), spark.createDataFrame([(1, i, r["pass"], r["fused"], r["state"]) for i, r in got.items()], "match bigint, id bigint, pass string, fused string, state string")).first()
    assert (done["reference"], done["passes"], done["aligned"], done["people"], done["linked"], done["review"], done["identities"]) == ("b", 5, 3, 15, 3, 2, 12)
    assert M.fuse_passes(spark.createDataFrame([], PEOPLE), spark.createDataFrame([], PASSES)).count() == 0


def plain_precision(boxes, pairs, least):
    truths = sum(b[3] == "gt" for b in boxes)
    used, flags, found = set(), [], set()
    for frame, pred, score in sorted(((b[0], b[1], b[2]) for b in boxes if b[3] == "pred"), key=lambda p: (-p[2], p[0], p[1])):
        free = [(iou, g) for f, g, p, _, iou in pairs if (f, p) == (frame, pred) and (f, g) not in used]
        iou, g = max(free, default=(0.0, None))
        flags.append(iou >= least and g is not None)
        if flags[-1]:
            used.add((frame, g))
            found.add((frame, pred, g))
    precision = np.cumsum(flags) / np.arange(1, len(flags) + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return found, float(envelope[np.array(flags, dtype=bool)].sum() / truths) if truths else None


def test_greedy_average_precision(spark):
    r = np.random.default_rng(9)
    boxes, pairs = [], []
    for frame in range(60):
        truths, preds = int(r.integers(0, 4)), int(r.integers(0, 5))
        boxes += [(frame, f"g{k}", None, "gt") for k in range(truths)]
        for k in range(preds):
            score = float(r.integers(0, 6)) / 6
            boxes.append((frame, f"p{k}", score, "pred"))
            pairs += [(frame, f"g{g}", f"p{k}", score, float(r.choice([0.3, 0.5, 0.6, 0.6, 0.9]))) for g in range(truths) if r.random() < 0.6]
    b = spark.createDataFrame(boxes, "frame bigint, id string, score double, side string")
    p = spark.createDataFrame(pairs, "frame bigint, g_id string, p_id string, score double, iou double").repartition(3)
    found, area = plain_precision(boxes, pairs, 0.5)
    assert set(map(tuple, Q.greedy_truths(p, 0.5).collect())) == found and len(found) > 30
    got = Q.detection_average_precision(b, p).first()
    assert got["average_precision"] == pytest.approx(area) and (got["truths"], got["found"]) == (sum(x[3] == "gt" for x in boxes), len(found))
    none = Q.detection_average_precision(b.where("side = 'pred'"), p.limit(0)).first()
    assert none["average_precision"] is None and Q.detection_average_precision(b.where("side = 'gt'"), p.limit(0)).first()["average_precision"] == 0


def test_identity_maps_of_several_truths_are_the_best_of_all(spark):
    r = np.random.default_rng(12)
    rows = [(seq, t, None if r.random() < 0.1 else f"g{r.integers(0, 1 + seq % 4)}", None if r.random() < 0.15 else f"p{r.integers(0, 1 + seq % 3)}") for seq in range(25) for t in range(20)]
    got = {x["seq"]: x for x in Q.identity_f1(spark.createDataFrame(rows, "seq bigint, t bigint, gt string, pred string")).collect()}
    solved = 0
    for seq in range(25):
        mine = {x for x in rows if x[0] == seq and (x[2] or x[3])}
        truths, preds = sorted({x[2] for x in mine if x[2]}), sorted({x[3] for x in mine if x[3]})
        n = max(len(truths), len(preds))
        best = max(sum(any(a == x[2] and b == x[3] for a, b in zip(p, preds)) for x in mine if x[2] and x[3]) for p in itertools.permutations([*truths, *[None] * n], len(preds))) if preds else 0
        n_gt, n_pred = sum(bool(x[2]) for x in mine), sum(bool(x[3]) for x in mine)
        assert (got[seq]["idtp"], got[seq]["idfp"], got[seq]["idfn"]) == (best, n_pred - best, n_gt - best)
        solved += len(truths) > 1 and len(preds) > 1
    assert solved > 5
    double = spark.createDataFrame([(1, 0, "g", "p"), (1, 0, "g", "q"), (2, 0, "g", None)], "seq bigint, t bigint, gt string, pred string")
    assert sorted((x["seq"], x["status"], x["idf1"]) for x in Q.identity_f1(double).collect()) == [(1, "invalid", None), (2, "valid", 0.0)]
