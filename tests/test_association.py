"""The association rule for one pair against its columns, and the tracker's vetoes and evidence."""

import math
import random

from strandline.operators import association, comparison, tracking
from strandline.operators.association import Claims, pair_cost

PAIR = "id int, dt double, image double, height double, last_height double, appearance double, reid double, reid_support int, pitch double, uncertainty double, marked boolean, fallback boolean, a_team string, a_owners array<string>, a_binding string, a_player string, b_team string, b_owners array<string>, b_binding string, b_player string"


def test_columns_give_what_the_rule_gives(spark):
    r = random.Random(5)
    maybe = lambda x, p=0.5: x if r.random() < p else None
    claims = lambda: (maybe(r.choice("xy"), 0.2), r.sample("uvw", r.randint(0, 1)), maybe(r.choice("bc"), 0.2), maybe(r.choice("pq"), 0.3))
    rows = [(i, r.uniform(-0.02, 0.8), r.uniform(0, 300), r.uniform(1, 90), r.uniform(0.2, 90), r.uniform(0, 3), maybe(r.uniform(0, 2)), r.randint(0, 3), maybe(r.uniform(0, 15)), r.uniform(0, 8), r.random() < 0.1, r.random() < 0.8, *claims(), *claims()) for i in range(3000)]
    got = {x["id"]: (x["cost"], x["reason"]) for x in association.association_costs(spark.createDataFrame(rows, PAIR)).collect()}
    reasons = set()
    for i, *e in rows:
        a, b = (Claims(t, frozenset(o), k, p) for t, o, k, p in (e[11:15], e[15:19]))
        cost, reason = pair_cost(*e[:9], a, b, e[9], e[10])
        reasons.add(reason)
        assert got[i][1] == reason
        assert got[i][0] is None if math.isinf(cost) else math.isclose(got[i][0], cost, rel_tol=1e-12, abs_tol=1e-15)
    assert len(reasons) == 11


def test_four_profiles_by_hand():
    pair = lambda reid, pitch: pair_cost(0.1, 48.0, 10.0, 10.0, 0.45, reid, 5, pitch, 0.0)[0]
    assert math.isclose(pair(None, None), 0.58 + 0.17)
    assert math.isclose(pair(0.19, None), 0.51 + 0.09 + 0.125)
    assert math.isclose(pair(None, 1.9), 0.10 + 0.09 + 0.31)
    assert math.isclose(pair(0.19, 1.9), 0.08 + 0.04 + 0.11 + 0.285)
    assert pair(0.73, 1.9) == math.inf and pair(None, 3.9) == math.inf


def test_tracker_heeds_vetoes_and_reid(spark):
    schema = "scene string, det_id int, t double, x double, y double, height double, confidence double, feature array<double>, pitch_x double, pitch_z double, uncertainty double, reid array<double>, team string, player string"
    one = lambda scene, k, t, x, reid=None, team=None, player=None: (scene, k, t, x, 50.0, 40.0, 0.9, [1.0, 0.0], None, None, None, reid, team, player)
    rows = [one("team", 0, 0.0, 100.0, team="home"), one("team", 1, 0.1, 101.0, team="away"), one("same", 0, 0.0, 100.0, team="home"), one("same", 1, 0.1, 101.0), one("player", 0, 0.0, 100.0, player="p"), one("player", 1, 0.1, 101.0), one("player", 2, 0.2, 102.0, player="q")]
    rows += [one("reid", k, 0.1 * k, 100.0 + k, reid=[1.0, 0.0]) for k in range(3)] + [one("reid", 3, 0.3, 103.0, reid=[0.0, 1.0])]
    rows += [one("zero", 0, 0.0, 100.0, reid=[0.0, 0.0]), one("zero", 1, 0.1, 101.0, reid=[0.0, 1.0])]
    got = {}
    for x in tracking.track(spark.createDataFrame(rows, schema), "scene").collect():
        got.setdefault(x["scene"], {})[x["det_id"]] = x["track"]
    assert got["team"] == {0: 0, 1: 1} and got["same"] == {0: 0, 1: 0} and got["player"] == {0: 0, 1: 0, 2: 1}
    assert got["reid"] == {0: 0, 1: 0, 2: 0, 3: 1} and got["zero"] == {0: 0, 1: 0}


def test_embedding_problems_and_empty_tables(spark):
    crops = spark.createDataFrame([("a", True, [0.6, 0.8], "r", "r"), ("b", True, [0.6, None], "r", "s"), ("c", True, [0.0, 0.0], "s", "zz"), ("d", None, [0.6, 0.8], "r", "r"), ("e", True, None, "r", "r"), ("f", True, [3.0, 4.0], "s", "s"), ("g", True, [1.0], "s", None), ("h", True, [float("nan"), 1.0], None, "r")], "id string, usable boolean, embedding array<double>, role string, predicted string")
    got = {r["id"]: r["problem"] for r in comparison.embedding_problems(crops, 2).collect()}
    assert got == {"a": None, "b": "embedding-non-finite", "c": "embedding-zero", "d": "worker-marked-unusable", "e": "embedding-dimension-invalid", "f": "embedding-not-normalized", "g": "embedding-dimension-invalid", "h": "embedding-non-finite"}
    row = comparison.identity_contract(crops, ["r", "s"], 2, 0.1, 0.3).first()
    assert (row["total"], row["valid"], row["contract_passes"], row["usable_passes"], row["roles_pass"]) == (8, 1, False, True, True)
    none = comparison.identity_contract(crops.where("false"), ["r", "s"], 2, 0.1, 0.3).first()
    assert none["total"] == 0 and not (none["contract_passes"] or none["usable_passes"] or none["roles_pass"])
