"""The inspection operators on rows whose results are known."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import assign, inspection, quality

POINT = "track long, frame long, t double, x double, z double"


def test_steps_skip_unplaced_points(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, None, 0.0), (1, 2, 2.0, 30.0, 40.0), (1, 3, 3.0, 50.0, 40.0), (1, 3, 3.0, 51.0, 40.0), (1, 4, None, 0.0, 0.0), (2, 5, float("nan"), 1.0, 1.0), (2, 6, 1.0, 1.0, None)]
    got = {(r.track, r.frame, r.delta): (r.previous_frame, r.speed, r.severity) for r in inspection.step_samples(spark.createDataFrame(rows, POINT)).collect()}
    assert got == {(1, 0, None): (None, None, "ok"), (1, 1, None): (0, None, "unprojected"), (1, 2, 50.0): (0, 25.0, "speed-violation"), (1, 3, 20.0): (2, 20.0, "speed-violation"), (1, 3, 1.0): (3, None, "ok"), (2, 6, None): (None, None, "unprojected")}


def test_edges_count_a_track_once(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 26.0, 0.0), (1, 1, 2.0, 26.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 15.0, 0.0), (3, 0, 0.0, 0.0, 0.0), (3, 1, 1.0, None, 0.0)]
    samples = inspection.step_samples(spark.createDataFrame(rows, POINT))
    assert [tuple(r) for r in inspection.population_edges(samples).collect()] == [(0, 1, 3, 2, 1)]
    assert inspection.population_edges(samples.limit(0)).count() == 0


@pytest.mark.parametrize("ahead, x", [(0.2, 12.0), (5.0, 13.5), (-1.0, 10.0)])
def test_prediction_stops_at_the_horizon(spark, ahead, x):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 10.0, 0.0)]
    got = inspection.predicted_points(spark.createDataFrame(rows, "track long, id long, t double, x double, z double"), ahead).orderBy("id").collect()
    assert [got[0].x, got[1].x] == [0.0, pytest.approx(x)]


def test_consensus(spark):
    rows = [("a", "ready", "pass", 3, 6, "replay-overlap"), ("a", "ready", "reject", 2, 5, None), ("a", "failed", "pass", 9, 9, "replay-overlap"), ("b", "failed", "pass", 9, 9, None), ("c", "ready", None, None, None, None)]
    got = {r.scene: tuple(r)[1:] for r in inspection.consensus(spark.createDataFrame(rows, "scene string, status string, verdict string, balls long, tracks long, relation string")).collect()}
    assert got == {"a": (2, 1, 1, 1, 1, 0.542), "b": (0, 0, 0, 0, 0, 0.0), "c": (1, 0, 0, 0, 0, 0.083)}


def test_observation_score(spark):
    rows = [(0.5, 90.0, 90.0, "ready", True, "recognized"), (2.0, 900.0, 900.0, "poor", None, "ambiguous"), (None, -3.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "c double, w double, h double, reid string, usable boolean, number string")
    got = [r[0] for r in df.select(inspection.observation_score(*map(F.col, df.columns))).collect()]
    assert got == [pytest.approx(1.2), pytest.approx(1.18), 0.0]


def test_successors_against_all_choices(spark):
    draw = random.Random(3)
    rows = [(k, a, b, draw.randrange(100) / 100) for k in range(12) for a in range(3) for b in range(4) if draw.random() < 0.7]
    got = assign.successors(spark.createDataFrame([*rows, (0, 0, 9, None), rows[0]], "k long, a long, b long, s double"), "k", "a", "b", "s", 0.5).collect()
    assert len(got) == len(rows) + 1 and not any(r.selected for r in got if r.s is None)
    for k in range(12):
        score = {(a, b): s for kk, a, b, s in rows if kk == k}
        worth = lambda pairs: sum(score[p] - 0.5 for p in pairs)
        choices = (c for n in range(4) for c in itertools.combinations(score, n) if len({a for a, _ in c}) == n == len({b for _, b in c}))
        chosen = [(r.a, r.b) for r in got if r.k == k and r.selected]
        assert len({a for a, _ in chosen}) == len(chosen) == len({b for _, b in chosen})
        assert worth(chosen) == pytest.approx(max(map(worth, choices)), abs=1e-5)


def test_partition_crops_against_a_loop(spark):
    draw = random.Random(5)
    points = [(i % 2, i, i, draw.randrange(80) / 10, float(draw.choice([0, 20, 40, 60])), float(draw.choice([30, 96, 120])), draw.choice([0.2, 0.9, None])) for i in range(120)]
    points.append((0, 200, 1, 1.0, float("nan"), 10.0, 0.5))
    ranges = [(0, 1, 1.0, 3.0), (1, 1, 2.0, 5.0)]
    got = inspection.partition_crops(spark.createDataFrame(points, "track long, id long, frame long, t double, w double, h double, conf double"), spark.createDataFrame(ranges, "number long, track long, s double, e double")).collect()

    def quality(w, h, c):
        return min(1, 0.5 * (c or 0) + 0.25 * min(1, h / 96) + 0.15 * min(1, w / 40) + 0.1 * max(0, 1 - abs(w / max(1, h) - 0.42) / 0.42))

    parts = {}
    for track, i, frame, t, w, h, c in points:
        if w > 0:
            part = ",".join(str(n) for n, of, s, e in ranges if of == track and s <= t < e)
            parts.setdefault((track, part), []).append((-quality(w, h, c), -(c if c is not None else -1.0), t, frame, i))
    want = set()
    for key, rows in parts.items():
        taken = []
        for r in sorted(rows):
            if len(taken) < 5 and all(abs(r[2] - x[2]) >= 0.45 for x in taken):
                taken.append(r)
        want |= {(*key, r[4]) for r in taken}
    assert {(r.track, r.partition, r.id) for r in got} == want


def test_model_comparison(spark):
    rows = [(1, 100, 0, 15, 15, -1), (2, 100, 0, 14, 0, 0), (3, 100, 15, 0, -15, -1), (4, 100, 15, 0, 0, 0), (5, 0, 0, 3, 3, 0)]
    got = {r.scene: (r.gain, r.verdict) for r in inspection.model_comparison(spark.createDataFrame(rows, "scene long, frames long, baseline_inside long, candidate_inside long, outside_delta long, stable_delta long")).collect()}
    assert got == {1: (15, "candidate"), 2: (14, "review"), 3: (-15, "baseline"), 4: (-15, "review"), 5: (3, "candidate")}


def test_late_publications_are_dropped(spark):
    jobs = spark.createDataFrame([("a", "x", "processing", 10.0), ("b", "x", "cancelled", 10.0), ("a", "x", "processing", 9.0)], "run_id string, fingerprint string, status string, expires_at double")
    rows = [("a", "x", 9.5), ("a", "y", 1.0), ("a", "x", 10.0), ("b", "x", 1.0), ("c", "x", 1.0), ("a", None, 1.0)]
    got = inspection.fenced(spark.createDataFrame(rows, "run_id string, fingerprint string, at double"), jobs, ["processing"]).collect()
    assert [tuple(r) for r in got] == [("a", "x", 9.5)]


def test_precision_recall_over_many_ranges(spark):
    """Scores between 0 and 1, a third of them tied, against a plain loop."""
    draw = random.Random(7)
    rows = [(i, int(draw.random() < 0.4), 0.5 if i % 3 == 0 else draw.random()) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = quality.precision_recall(spark.createDataFrame([*rows, (900, 1, None)], "id long, truth int, score double")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    tp = list(itertools.accumulate(r[1] for r in order))
    precision = [t / k for k, t in enumerate(tp, 1)]
    envelope = list(itertools.accumulate(reversed(precision), max))[::-1]
    want = {r[0]: (k + 1, tp[k], pytest.approx(precision[k]), pytest.approx(tp[k] / tp[-1]), pytest.approx(envelope[k])) for k, r in enumerate(order)}
    assert {r.id: (r.rank, r.tp, r.precision, r.recall, r.envelope) for r in out} == want
