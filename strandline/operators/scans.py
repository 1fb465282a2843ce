"""How a stretch of frames is scanned: regions or whole frames, a circuit for a detector that fails, retries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut
from .groups import Rows, each_group


@dataclass(frozen=True)
class ScanConfig:
    #: Every so many frames the whole frame is scanned.
    interval: int = 10
    #: Frames that an open circuit stays with the other detector before the first one is tried again.
    cooldown: int = 5


def scan_modes(frames: DataFrame, key: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row per frame: (key, frame, mode, reason, circuit, hit), each depending on the frames before it.

    ``frames``: key, frame, cut (the camera cut since the frame before), regions (valid ones, had there been
    something to look around), works (the detector), roi_hit, global_hit, other_hit (what a scan of the
    regions, of the whole frame, and the other detector would find). Modes: ``roi`` where the last frame had
    something and nothing calls for a whole scan, ``reacquire`` where the regions then had nothing, ``global``
    with its reason (cut, first, last, periodic, nothing-before, no-region), ``other`` while the circuit is
    open. A failure opens it; after ``cooldown`` frames one trial closes it or opens it again. ``circuit``:
    closed, opened, open, trial-failed, trial-closed. Null flags are false. A scene is folded in its order.
    """
    kind = frames.schema[key].dataType.simpleString()

    def fold(rows: Rows) -> list[tuple]:
        before, open_, wait, out = False, False, 0, []
        for i, r in enumerate(rows):
            if open_ and wait > 0:
                wait -= 1
                before = bool(r["other_hit"])
                out.append((r[key], r["frame"], "other", "circuit", "open", before))
                continue
            if not r["works"]:
                state = "trial-failed" if open_ else "opened"
                open_, wait, before = True, config.cooldown, bool(r["other_hit"])
                out.append((r[key], r["frame"], "other", "failure", state, before))
                continue
            state, open_ = ("trial-closed" if open_ else "closed"), False
            whole = "cut" if r["cut"] else "first" if i == 0 else "last" if i == len(rows) - 1 else "periodic" if i % config.interval == 0 else "nothing-before" if not before else "no-region" if not r["regions"] else None
            if whole:
                mode, reason, before = "global", whole, bool(r["global_hit"])
            elif r["roi_hit"]:
                mode, reason, before = "roi", None, True
            else:
                mode, reason, before = "reacquire", "region-miss", bool(r["global_hit"])
            out.append((r[key], r["frame"], mode, reason, state, before))
        return out

    return each_group(frames, [key], ["frame"], fold, f"{key} {kind}, frame bigint, mode string, reason string, circuit string, hit boolean")


def crop_costs(modes: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """What the modes of a scene cost in crops: frames by mode, crops of whole frames (``tiles``) and regions, those of
    whole scans of every frame, and the share saved (null without any). ``frames``: key, frame, tiles, regions."""
    whole, part = F.col("mode").isin("global", "reacquire"), F.col("mode").isin("roi", "reacquire")
    rows = modes.join(frames.select(key, "frame", "tiles", "regions"), [key, "frame"])
    sums = rows.groupBy(key).agg(
        F.count("*").alias("frames"), *(F.count_if(F.col("mode") == m).alias(m) for m in ("global", "roi", "reacquire", "other")), F.coalesce(F.sum(F.when(whole, F.col("tiles"))), F.lit(0)).alias("global_crops"),
        F.coalesce(F.sum(F.when(part, F.col("regions"))), F.lit(0)).alias("roi_crops"), F.coalesce(F.max(F.when(whole, F.col("tiles"))), F.lit(0)).alias("largest"),
    )
    every = F.col("largest") * F.col("frames")
    return sums.select(key, "frames", "global", "roi", "reacquire", "other", "global_crops", "roi_crops", every.alias("every_crops"), F.round(1 - F.try_divide(F.col("global_crops") + F.col("roi_crops"), every), 4).alias("saved"))


def retried(requests: DataFrame, key: str, solve: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """All attempts (what ``solve`` gives, and ``round``): the first over all requests, then at most two more
    rounds over those that have no accepted attempt yet.

    ``solve(pending, round)`` gives rows with ``key`` and ``accepted``; a request may get no attempt. Each round is
    written before the next begins, so a lost executor repeats no round that is done.
    """
    done = cut(solve(requests, 0).withColumn("round", F.lit(0)))
    for k in range(1, max(0, min(2, rounds)) + 1):
        pending = requests.join(done.where("accepted").select(key), key, "left_anti")
        if pending.isEmpty():
            break
        done = done.unionByName(cut(solve(pending, k).withColumn("round", F.lit(k))))
    return done


def settled(attempts: DataFrame, key: str) -> DataFrame:
    """Per request the attempt that counts: the first accepted one, else that of fewest reasons, least residual, then the first.
    Adds ``tries``. ``attempts``: key, round, accepted, reasons (a number), residual."""
    far = F.coalesce("residual", F.lit(float("inf")))
    rank = F.struct((~F.col("accepted")).alias("open"), F.when(F.col("accepted"), F.lit(0)).otherwise(F.col("reasons")).alias("reasons"), F.when(F.col("accepted"), F.lit(0.0)).otherwise(far).alias("far"), "round")
    best = attempts.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "residual")).alias("b"), F.count("*").alias("tries"))
    return best.select(key, F.col("b.rank.round").alias("round"), (~F.col("b.rank.open")).alias("accepted"), F.col("b.residual").alias("residual"), "tries")
