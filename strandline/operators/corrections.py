"""Corrections that people make: an append-only log with revisions and undo, nested splits in their order,
roster bindings, rejected candidates, and what a corrected track is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checkpoint import cut
from .groups import Rows, each_group


def ordered_splits(splits: DataFrame) -> DataFrame:
    """(scene, id, position): nested splits in the order in which they apply.

    ``splits``: scene, id, source, produced, start, stop. A split whose source another split produces comes
    after that one; of those that may come next the one with the least (start, stop, id) does. Unknown times
    come last. Two splits that produce one identity, or a lineage that is a cycle, make the job fail.

    The path from the root decides: the next one to come always extends a path whose largest key is least,
    so splits are sorted by the largest key of their path, then by the largest after that one, and so on.
    Paths are put together by doubling, so the rounds grow with the logarithm of the depth.
    """
    far = F.lit(float("inf"))
    s = splits.select("scene", "id", "source", "produced", F.struct(F.coalesce(F.col("start").cast("double"), far).alias("start"), F.coalesce(F.col("stop").cast("double"), far).alias("stop"), "id").alias("key"))
    made = s.where(F.col("produced").isNotNull()).groupBy("scene", "produced").agg(F.min("id").alias("parent"), F.max("id").alias("other"))
    twice = F.raise_error(F.concat(F.lit("two splits produce "), F.col("produced").cast("string"))).cast(splits.schema["id"].dataType)
    made = made.select("scene", F.col("produced").alias("source"), F.when(F.col("parent") != F.col("other"), twice).otherwise(F.col("parent")).alias("parent"))
    now = cut(s.join(made, ["scene", "source"], "left").select("scene", "id", "parent", F.array("key").alias("path")))
    most, steps = now.count(), 1
    while not now.where(F.col("parent").isNotNull()).isEmpty():
        if steps > most:
            raise ValueError("the lineage of the splits has a cycle")
        above = now.select("scene", F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("path").alias("before"))
        joined = now.join(above, ["scene", "parent"], "left")
        now = cut(joined.select("scene", "id", F.col("above").alias("parent"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")))
        steps *= 2
    # From the end of the path: every key larger than all that follow it.
    ranks = F.reverse(F.aggregate(F.slice(F.reverse("path"), 2, 2**30), F.array(F.element_at("path", -1)), lambda acc, k: F.when(k > F.element_at(acc, -1), F.concat(acc, F.array(k))).otherwise(acc)))
    return now.select("scene", "id", F.row_number().over(Window.partitionBy("scene").orderBy(ranks)).cast("long").alias("position"))


def log_verdicts(log: DataFrame, by: list[str]) -> DataFrame:
    """What an append-only log of edits comes to: one row per entry with its verdict, and the state after it.

    ``log``: the columns ``by`` (of the thing edited), seq, op (set, delete, undo), expected (the revision that
    the writer saw, 0 at first), value. An entry is accepted if the revision is the expected one, and raises it
    by one; of writers who saw the same revision the first wins. An undo takes back the last accepted set or
    delete that is not taken back yet, so what stood before it stands again; with nothing to take back it is
    refused. Gives by, seq, verdict (accepted, conflict, nothing-to-undo), revision and value (null: absent)
    after the entry. The edits of one thing are folded in order; they are made by people, so they are few.
    """
    entry = F.struct("seq", "op", "expected", "value")
    sorted_ = log.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    value = log.schema["value"].dataType.simpleString()
    step = f"struct<seq:{log.schema['seq'].dataType.simpleString()},verdict:string,revision:bigint,value:{value}>"
    start = F.struct(F.lit(0).cast("bigint").alias("revision"), F.array().cast(f"array<{value}>").alias("stack"), F.array().cast(f"array<{step}>").alias("steps"))

    def fold(acc: Column, e: Column) -> Column:
        fits = e["expected"].eqNullSafe(acc["revision"])
        undo = e["op"] == "undo"
        verdict = F.when(~fits, "conflict").when(undo & (F.size(acc["stack"]) == 0), "nothing-to-undo").otherwise("accepted")
        good = fits & ~(undo & (F.size(acc["stack"]) == 0))
        revision = acc["revision"] + F.when(good, 1).otherwise(0)
        pushed = F.concat(acc["stack"], F.array(F.when(e["op"] == "set", e["value"])))
        stack = F.when(~good, acc["stack"]).when(undo, F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(pushed)
        top = F.get(stack, F.size(stack) - 1)
        return F.struct(revision.alias("revision"), stack.alias("stack"), F.concat(acc["steps"], F.array(F.struct(e["seq"].alias("seq"), verdict.alias("verdict"), revision.alias("revision"), top.alias("value")))).alias("steps"))

    return sorted_.select(*by, F.explode(F.aggregate("entries", start, fold, lambda acc: acc["steps"])).alias("s")).select(*by, "s.*")


def log_state(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The latest view of ``log_verdicts``: by, revision, value; things that are absent have no row.

    Of entries with one seq the last has the highest revision; those that share it left the same value."""
    last = verdicts.groupBy(*by).agg(F.max_by(F.struct("revision", "value"), F.struct("seq", "revision")).alias("s")).select(*by, "s.*")
    return last.where(F.col("value").isNotNull())


def roster_log(log: DataFrame) -> DataFrame:
    """Verdicts of an append-only log of roster decisions, and who is bound to whom after each.

    ``log``: scene, seq, person, op, player. ``bind`` gives the person a player whom nobody else of the scene
    has (else player-taken) and who is not the person's already; ``unbind`` says that the person is no player of
    the roster, and frees the one bound; ``clear`` forgets an unbind with all that an undo could bring back (a
    bound player must be unbound first); ``undo`` restores what stood before the person's last decision, unless
    the player is taken by now. Gives scene, seq, person, verdict, state (bound, unbound, open) and player.
    Decisions of a scene depend on each other and are folded in their order; they are made by people.
    """
    kind = log.schema["scene"].dataType.simpleString()

    def fold(rows: Rows) -> list[tuple]:
        stands: dict[str, list[tuple[str, str | None]]] = {}
        owner: dict[str, str] = {}
        out = []
        for r in rows:
            person, player = r["person"], r["player"]
            past = stands.setdefault(person, [("open", None)])
            state, bound = past[-1]
            verdict, new = "accepted", None
            if r["op"] == "bind":
                if player is None:
                    verdict = "no-player"
                elif owner.get(player, person) != person:
                    verdict = "player-taken"
                elif bound == player:
                    verdict = "bound-already"
                else:
                    new = [*past, ("bound", player)]
            elif r["op"] == "unbind":
                verdict, new = ("unbound-already", None) if state == "unbound" else ("accepted", [*past, ("unbound", None)])
            elif r["op"] == "clear":
                verdict, new = ("accepted", [("open", None)]) if state == "unbound" else ("unbind-first" if state == "bound" else "nothing-to-clear", None)
            elif r["op"] == "undo":
                if len(past) == 1:
                    verdict = "nothing-to-undo"
                elif owner.get(past[-2][1], person) != person:
                    verdict = "player-taken"
                else:
                    new = past[:-1]
            else:
                verdict = "unknown-decision"
            if new is not None:
                if bound is not None:
                    del owner[bound]
                stands[person] = new
                if new[-1][1] is not None:
                    owner[new[-1][1]] = person
            out.append((r["scene"], r["seq"], person, verdict, *stands[person][-1]))
        return out

    return each_group(log.select("scene", "seq", "person", "op", "player"), ["scene"], ["seq"], fold, f"scene {kind}, seq bigint, person string, verdict string, state string, player string")


def rejections(decisions: DataFrame, candidates: DataFrame, bound: DataFrame) -> DataFrame:
    """Rejections (scene, person, player) that stand, once each with the first ``said``: of a published
    candidate (``candidates``: scene, person, player) that the person is not bound to (``bound``, alike)."""
    keys = ["scene", "person", "player"]
    return decisions.join(candidates, keys, "left_semi").join(bound, keys, "left_anti").groupBy(*keys).agg(F.min("said").alias("said"))


def partition_state(points: DataFrame, by: str) -> DataFrame:
    """What a corrected track is, from its own points only: n, observed, first and last time, mean and
    best confidence with the point that has it (the earliest on a tie), and its majority kind (the first in
    order on a tie). ``points``: by, event_id, t, conf, observed, kind."""
    kinds = points.where(F.col("kind").isNotNull()).groupBy(by, "kind").agg(F.count("*").alias("votes")).groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "kind")).alias("k"))
    own = points.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(F.col("observed").cast("int")).alias("observed"), F.min("t").alias("first"), F.max("t").alias("last"), F.avg("conf").alias("conf"),
        F.min(F.when(F.col("conf").isNotNull(), F.struct((-F.col("conf")).alias("c"), "t", "event_id"))).alias("best"),
    )
    return own.join(kinds, by, "left").select(by, "n", "observed", "first", "last", "conf", (-F.col("best.c")).alias("best_conf"), F.col("best.event_id").alias("best_id"), F.col("k.kind").alias("kind"))
