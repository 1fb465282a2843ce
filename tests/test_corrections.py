"""The order of nested splits, the log of edits and roster decisions against plain versions."""

import heapq

import numpy as np
import pytest

from strandline.operators import corrections as C
from strandline.plans import correction_queries as Q

SPLITS = "scene bigint, id string, source string, produced string, start double, stop double"


def in_order(rows):
    """By taking, again and again, the first in order of those whose parents are done."""
    made = {r[3]: r[1] for r in rows if r[3]}
    key = {r[1]: (r[4] if r[4] is not None else float("inf"), r[5] if r[5] is not None else float("inf"), r[1]) for r in rows}
    children = {}
    for r in rows:
        children.setdefault(made.get(r[2]), []).append(r[1])
    ready, out = [key[i] for i in children.get(None, [])], []
    heapq.heapify(ready)
    while ready:
        *_, i = heapq.heappop(ready)
        out.append(i)
        for c in children.get(i, []):
            heapq.heappush(ready, key[c])
    return out


def test_splits_come_in_the_order_of_a_priority_queue(spark):
    r = np.random.default_rng(3)
    scenes = {}
    for scene in range(60):
        n = int(r.integers(1, 25))
        rows = []
        for i in range(n):
            parent = int(r.integers(0, i)) if i and r.random() < 0.8 else None
            rows.append((scene, f"c{i:02d}", f"p{parent}" if parent is not None else "track", f"p{i}" if r.random() < 0.95 else None, float(r.integers(0, 5)) if r.random() < 0.9 else None, float(r.integers(0, 3))))
        scenes[scene] = [rows[k] for k in r.permutation(n)]
    got = {}
    for row in sorted(C.ordered_splits(spark.createDataFrame([x for rows in scenes.values() for x in rows], SPLITS)).collect(), key=lambda x: x["position"]):
        got.setdefault(row["scene"], []).append(row["id"])
    assert got == {scene: in_order(rows) for scene, rows in scenes.items()}


def test_a_long_chain_and_a_child_that_starts_with_its_parent(spark):
    chain = [(1, f"{99 - i:03d}", f"p{i - 1}" if i else "t", f"p{i}", 0.0, 1.0) for i in range(100)]
    got = sorted(C.ordered_splits(spark.createDataFrame(chain, SPLITS)).collect(), key=lambda r: r["position"])
    assert [r["id"] for r in got] == [c[1] for c in chain]
    assert C.ordered_splits(spark.createDataFrame([], SPLITS)).count() == 0


@pytest.mark.parametrize("rows,message", [([("a", "t", "x"), ("b", "u", "x"), ("c", "x", None)], "two splits produce x"), ([("a", "y", "x"), ("b", "x", "y"), ("c", "t", None)], "cycle"), ([("a", "x", "x")], "cycle")])
def test_broken_lineages_fail(spark, rows, message):
    with pytest.raises(Exception, match=message):
        C.ordered_splits(spark.createDataFrame([(1, i, s, p, 0.0, 1.0) for i, s, p in rows], SPLITS)).collect()


def test_the_log_is_optimistic_and_undo_restores(spark):
    r = np.random.default_rng(6)
    rows, want, state = [], {}, {}
    for thing in range(30):
        revision, stack = 0, []
        for seq in range(int(r.integers(1, 20))):
            op, expected, value = str(r.choice(["set", "set", "delete", "undo"])), revision + int(r.choice([0, 0, 0, 0, -1, 1])), f"v{seq}"
            rows.append((thing, seq, op, expected, value))
            if expected != revision:
                verdict = "conflict"
            elif op == "undo" and not stack:
                verdict = "nothing-to-undo"
            else:
                verdict, revision = "accepted", revision + 1
                stack = stack[:-1] if op == "undo" else [*stack, value if op == "set" else None]
            want[thing, seq] = (verdict, revision, stack[-1] if stack else None)
        if stack and stack[-1] is not None:
            state[thing] = (revision, stack[-1])
    log = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "id bigint, seq bigint, op string, expected bigint, value string")
    verdicts = C.log_verdicts(log, ["id"])
    assert {(v["id"], v["seq"]): (v["verdict"], v["revision"], v["value"]) for v in verdicts.collect()} == want
    assert {v["id"]: (v["revision"], v["value"]) for v in C.log_state(verdicts, ["id"]).collect()} == state
    assert {v[0] for v in want.values()} == {"accepted", "conflict", "nothing-to-undo"}


def log_of_lines(spark, folder, query, rows):
    """What a query of the log gives for lines of one part (order, number, supplier, quantity) that stand so in their file."""
    spark.createDataFrame([(1, *r) for r in rows], "l_partkey bigint, l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return sorted(tuple(r) for r in query(spark, str(folder)).collect())


#: Two lines of one order and number: whichever is numbered first was written by one who saw revision 0.
TIED = [(5, 2, 3, 1.0), (5, 2, 4, 10.0), (6, 1, 8, 3.0)]


def test_lines_of_one_order_and_number_are_numbered_alike_however_they_stand(spark, tmp_path):
    both = [log_of_lines(spark, tmp_path / str(k), Q.correction_log, rows) for k, rows in enumerate((TIED, TIED[::-1]))]
    assert both[0] == both[1] == [(1, 52, "accepted", 1, 3), (1, 52, "accepted", 2, None), (1, 61, "accepted", 3, 8)]


def test_the_state_does_not_hang_on_how_lines_stand(spark, tmp_path):
    both = [log_of_lines(spark, tmp_path / str(k), Q.correction_state, rows) for k, rows in enumerate((TIED, TIED[::-1]))]
    assert both[0] == both[1] == [(1, 3, 8)]


def test_the_state_is_that_after_the_last_of_several_entries_with_one_seq(spark):
    log = spark.createDataFrame([(1, 1, "set", 0, "a"), (1, 2, "set", 1, "b"), (1, 2, "set", 2, "c"), (1, 2, "set", 9, "d")], "id bigint, seq bigint, op string, expected bigint, value string")
    rows = [tuple(r) for r in C.log_verdicts(log, ["id"]).collect()]
    for given in (rows, rows[::-1]):
        verdicts = spark.createDataFrame(given, "id bigint, seq bigint, verdict string, revision bigint, value string").coalesce(1)
        assert [tuple(r) for r in C.log_state(verdicts, ["id"]).collect()] == [(1, 3, "c")]


def decided(spark, *rows):
    log = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "scene bigint, seq bigint, person string, op string, player string")
    return [(r["verdict"], r["state"], r["player"]) for r in sorted(C.roster_log(log.repartition(3)).collect(), key=lambda r: r["seq"])]


def test_roster_decisions(spark):
    assert decided(spark, ("a", "bind", "p"), ("b", "bind", "p"), ("a", "bind", "q"), ("b", "bind", "p"), ("a", "undo", None), ("b", "unbind", None), ("a", "undo", None), ("a", "undo", None)) == [
        ("accepted", "bound", "p"), ("player-taken", "open", None), ("accepted", "bound", "q"), ("accepted", "bound", "p"), ("player-taken", "bound", "q"), ("accepted", "unbound", None), ("accepted", "bound", "p"), ("accepted", "open", None),
    ]
    # What is cleared cannot be brought back by an undo.
    assert decided(spark, ("a", "bind", "p"), ("a", "clear", None), ("a", "unbind", None), ("a", "unbind", None), ("a", "clear", None), ("a", "undo", None), ("a", "clear", None), ("a", "jump", None), ("a", "bind", None)) == [
        ("accepted", "bound", "p"), ("unbind-first", "bound", "p"), ("accepted", "unbound", None), ("unbound-already", "unbound", None), ("accepted", "open", None), ("nothing-to-undo", "open", None), ("nothing-to-clear", "open", None), ("unknown-decision", "open", None), ("no-player", "open", None),
    ]


def test_no_player_is_ever_bound_twice(spark):
    r = np.random.default_rng(2)
    rows = [(i % 5, i, str(r.integers(0, 4)), str(r.choice(["bind", "bind", "unbind", "undo", "clear"])), str(r.integers(0, 3))) for i in range(600)]
    log = spark.createDataFrame(rows, "scene bigint, seq bigint, person string, op string, player string")
    now = {}
    for v in sorted(C.roster_log(log).collect(), key=lambda v: (v["scene"], v["seq"])):
        now[v["scene"], v["person"]] = v["player"] if v["state"] == "bound" else None
        mine = [p for (s, _), p in now.items() if s == v["scene"] and p is not None]
        assert len(mine) == len(set(mine))
    assert len({v["verdict"] for v in C.roster_log(log).collect()}) >= 6


def test_rejections_of_bound_or_unpublished_candidates_do_not_stand(spark):
    kind = "scene bigint, person string, player string"
    said = spark.createDataFrame([(1, "a", "p", 5), (1, "a", "p", 3), (1, "a", "q", 1), (1, "b", "p", 1), (1, "c", "z", 1)], kind + ", said bigint")
    shown = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (1, "b", "p")], kind)
    got = C.rejections(said, shown, spark.createDataFrame([(1, "b", "p")], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "p", 3), (1, "a", "q", 1)]
