"""Borrowed and agreed calibrations, scans and retries against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import calibration as C
from strandline.operators import scans as S


def plain(m):
    m = m / (m[2, 2] if abs(m[2, 2]) >= 1e-10 else np.linalg.norm(m))
    return -m if m[2, 2] < 0 else m


def random_matrix(r):
    return np.eye(3) + np.diag([0.2, 0.1, 0.0]) + r.normal(size=(3, 3)) * 0.05


def test_borrowed_matrices_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    rows, by = [], {}
    for scene in range(12):
        t = 0.0
        for i in range(15):
            t += float(r.uniform(0.1, 1))
            ok, motion = bool(r.random() < 0.35), "estimated" if r.random() < 0.9 else str(r.choice(["reset", "lost"]))
            h, c = random_matrix(r) * float(r.choice([1, -2, 5])), random_matrix(r)
            if scene == 11 and i % 4 == 0:
                h = np.zeros((3, 3))
            by[scene, i] = (t, ok, motion, h, c)
            rows.append((scene, i, t, ok, h.reshape(-1).tolist(), c.reshape(-1).tolist(), motion))
    table = spark.createDataFrame(rows, "scene bigint, sample bigint, t double, accepted boolean, h array<double>, camera array<double>, motion string").cache()
    reasons = set()
    for source in ("previous", "next", "interpolation"):
        for x in C.borrowed(table, source).collect():
            s, i = x["scene"], x["sample"]
            a = max((k for k in range(i) if by[s, k][1]), default=None)
            b = min((k for k in range(i + 1, 15) if by[s, k][1]), default=None)
            first, last = {"previous": (a, i), "next": (i, b), "interpolation": (a, b)}[source]
            reasons.add(x["reason"])
            if first is None or last is None:
                assert x["reason"] == ("no-previous" if first is None else "no-next")
                continue
            if any(by[s, k][2] != "estimated" for k in range(first + 1, last + 1)):
                assert x["reason"] == "camera-boundary"
                continue
            ends = [k for k in (a, b) if k in (first, last) and k is not None]
            if any(abs(np.linalg.det(by[s, k][3])) < 1e-10 for k in ends):
                assert x["reason"] == "singular"
                continue
            stable = [plain(by[s, k][3] @ np.linalg.inv(by[s, k][4])) for k in ends]
            if source == "interpolation":
                w = (by[s, i][0] - by[s, a][0]) / (by[s, b][0] - by[s, a][0])
                other = -stable[1] if (stable[0] * stable[1]).sum() < 0 else stable[1]
                m = plain(stable[0] * (1 - w) + other * w)
                assert x["alpha"] == pytest.approx(w)
            else:
                m = stable[0]
            assert x["reason"] == "borrowed" and np.allclose(np.array(x["h"]).reshape(3, 3), plain(m @ by[s, i][4]), atol=1e-9)
    assert reasons == {"borrowed", "no-previous", "no-next", "camera-boundary", "singular"}
    with pytest.raises(ValueError):
        C.borrowed(table, "sideways")


def test_consensus_blends_what_both_sides_agree_on(spark):
    base = np.array([[0.05, 0.002, -40.0], [0.001, 0.09, -30.0], [0.0, 0.0008, 1.0]])
    near, far = base.copy(), base.copy()
    near[0, 2] += 0.8
    far[0, 2] += 200
    rows = [(1, 5, 2, True, 1.0, 0.9, base), (1, 5, 8, False, 3.0, 0.8, near), (2, 5, 2, True, 1.0, 0.9, base), (2, 5, 8, False, 3.0, 0.8, far), (3, 5, 2, True, 1.0, 0.9, base), (3, 5, 1, True, 2.0, 0.8, near)]
    found = spark.createDataFrame([(*x[:6], x[6].reshape(-1).tolist()) for x in rows], "scene bigint, sample bigint, anchor bigint, forward boolean, distance double, score double, h array<double>")
    frames = spark.createDataFrame([(s, 5, 10.0) for s in (1, 2, 3)], "scene bigint, sample bigint, t double")
    got = C.consensus(found, frames).collect()
    assert [(r["scene"], r["earlier"], r["later"], r["valid"]) for r in got] == [(1, 2, 8, 30)]  # far sides and one side only have none
    w = 0.25**2 * (3 - 0.5)
    assert got[0]["weight"] == pytest.approx(w)
    m = np.array(got[0]["h"]).reshape(3, 3)
    for x, y in ((400, 600), (960, 700), (1500, 950)):
        at = lambda k: (k @ [x, y, 1])[:2] / (k @ [x, y, 1])[2]
        assert np.allclose(at(m), at(base) * (1 - w) + at(near) * w, atol=1e-3)


FRAMES = "scene bigint, frame bigint, cut boolean, regions int, works boolean, roi_hit boolean, global_hit boolean, other_hit boolean, tiles int"


def test_scan_modes_and_the_circuit(spark):
    ok = dict(cut=False, regions=2, works=True, roi_hit=True, global_hit=True, other_hit=True)
    said = {3: {"roi_hit": False}, 4: {"cut": True}, 6: {"works": False}, 12: {"works": False}, 20: {"roi_hit": False, "global_hit": False}, 22: {"regions": 0}, 25: {"works": None}}
    rows = [(1, i, *(ok | said.get(i, {})).values(), 9) for i in range(40)]
    got = {r["frame"]: (r["mode"], r["reason"], r["circuit"]) for r in S.scan_modes(spark.createDataFrame(rows, FRAMES).repartition(4), "scene").collect()}
    assert got[0] == ("global", "first", "closed") and got[1] == ("roi", None, "closed") and got[3][:2] == ("reacquire", "region-miss") and got[4][:2] == ("global", "cut")
    assert got[6] == ("other", "failure", "opened") and [got[i][2] for i in range(7, 12)] == ["open"] * 5
    assert got[12] == ("other", "failure", "trial-failed") and [got[i][2] for i in range(13, 18)] == ["open"] * 5 and got[18][2] == "trial-closed"
    assert got[20][:2] == ("global", "periodic") and got[21][:2] == ("global", "nothing-before") and got[22][:2] == ("global", "no-region") and got[25][2] == "opened" and got[39][:2] == ("global", "last")
    assert S.scan_modes(spark.createDataFrame([], FRAMES), "scene").count() == 0


def test_retries_go_over_what_is_pending_only(spark):
    asked = []

    def solve(pending, k):
        ids = sorted(r["id"] for r in pending.collect())
        asked.append(ids)
        good = {0: {1, 2}, 1: {3}, 2: set(), 3: {4}}[k]
        return spark.createDataFrame([(i, i in good, 5 - k, float(i + k)) for i in ids if i != 6], "id bigint, accepted boolean, reasons int, residual double")

    requests = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    attempts = S.retried(requests, "id", solve, rounds=9)
    assert asked == [[1, 2, 3, 4, 5, 6], [3, 4, 5, 6], [4, 5, 6]]
    got = {r["id"]: (r["round"], r["accepted"], r["tries"]) for r in S.settled(attempts, "id").collect()}
    assert got == {1: (0, True, 1), 2: (0, True, 1), 3: (1, True, 2), 4: (2, False, 3), 5: (2, False, 3)}
    asked.clear()
    assert S.retried(requests.where("id < 3"), "id", solve).count() == 2 and len(asked) == 1
