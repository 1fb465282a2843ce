"""Calibration over time and evidence over several passes."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import multiply, project
from ..functions.numeric import hypot, let
from .scoring import hypothesis_score, hypothesis_uncertainty


@dataclass(frozen=True)
class PropagateConfig:
    horizon: float = 2.0
    anchors_each_way: int = 2
    least_score: float = 0.58
    most_uncertainty: float = 5.0
    rival_score: float = 0.10
    rival_distance: float = 2.5
    blend_uncertainty: float = 0.82
    width: float = 1920.0
    height: float = 1080.0


def hypotheses(frames: DataFrame, anchors: DataFrame, edges: DataFrame, c: PropagateConfig = PropagateConfig()) -> DataFrame:
    """Calibrations that each frame can take over from anchors before and after it.

    ``frames``: (scene, sample, t); ``anchors``: (scene, sample, t, h, confidence, inlier_ratio,
    uncertainty); ``edges``: (scene, at, h, confidence, residual, reliable), the motion from sample
    ``at`` to ``at`` + 1 as a 3x3 matrix from the later image to the earlier one, and ``back``, its inverse.
    An anchor counts only if every edge on the way is reliable.
    """
    bucket = lambda t: F.floor(t / c.horizon)
    a = anchors.select("scene", F.col("sample").alias("anchor"), F.col("t").alias("at_"), F.col("h").alias("ah"), F.col("confidence").alias("ac"), "inlier_ratio", F.col("uncertainty").alias("au"), bucket(F.col("t")).alias("b_"))
    asked = frames.withColumn("b_", F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)])))
    near = asked.join(a, ["scene", "b_"]).where((F.abs(F.col("t") - F.col("at_")) <= c.horizon) & (F.col("anchor") != F.col("sample"))).drop("b_")
    near = near.withColumn("forward", F.col("anchor") < F.col("sample"))
    steps = near.withColumn("at", F.explode(F.sequence(F.least("anchor", "sample"), F.greatest("anchor", "sample") - 1)))
    e = edges.select("scene", "at", F.col("h").alias("eh"), "back", F.col("confidence").alias("ec"), "residual", "reliable")
    laid = steps.join(e, ["scene", "at"], "left").groupBy("scene", "sample", "anchor").agg(
        F.bool_and(F.coalesce("reliable", F.lit(False))).alias("whole"),
        F.exp(F.avg(F.ln(F.greatest("ec", F.lit(1e-9))))).alias("path"),  # geometric mean
        F.sum("residual").alias("residuals"),
        F.array_sort(F.collect_list(F.struct("at", "eh", "back"))).alias("chain"),
        *[F.first(x).alias(x) for x in ("t", "at_", "ah", "ac", "inlier_ratio", "au", "forward")],
    )
    ok = laid.where("whole").withColumn("distance", F.abs(F.col("t") - F.col("at_")))
    rank = F.row_number().over(Window.partitionBy("scene", "sample", "forward").orderBy("distance", "anchor"))
    ok = ok.withColumn("rank", rank).where(F.col("rank") <= c.anchors_each_way)
    # From the frame's image to the anchor's image, then to the pitch.
    forward = F.aggregate("chain", F.col("ah"), lambda m, s: multiply(m, s["eh"]))
    backward = F.aggregate(F.reverse("chain"), F.col("ah"), lambda m, s: multiply(m, s["back"]))
    return ok.select(
        "scene", "sample", "anchor", "forward", "distance",
        hypothesis_score(F.col("ac"), F.col("inlier_ratio"), F.col("path"), F.col("distance")).alias("score"),
        hypothesis_uncertainty(F.col("au"), F.col("distance"), F.col("residuals"), F.col("path")).alias("uncertainty"),
        F.when(F.col("forward"), forward).otherwise(backward).alias("h"),
    )


def disagreement(a: Column, b: Column, c: PropagateConfig) -> Column:
    """Median distance on the pitch between two calibrations over a 5 x 4 grid of the image."""
    grid = F.array(*(F.struct(F.lit(c.width * (i + 0.5) / 5).alias("x"), F.lit(c.height * (j + 0.5) / 4).alias("y")) for i in range(5) for j in range(4)))
    sides = F.transform(grid, lambda g: F.struct(project(a, g["x"], g["y"]).alias("p"), project(b, g["x"], g["y"]).alias("q")))
    gaps = F.transform(sides, lambda s: hypot(s["p"]["x"] - s["q"]["x"], s["p"]["y"] - s["q"]["y"]))
    middle = lambda s: (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)) / 2
    return let(F.array_sort(F.array_compact(gaps)), lambda s: F.when(F.size(s) > 0, middle(s)))


def propagate(found: DataFrame, c: PropagateConfig = PropagateConfig()) -> DataFrame:
    """One row per frame with a hypothesis: the best one's state, and its uncertainty, less where the
    other direction agrees. Rejected: contested by a rival about as good that lies elsewhere, weak, or uncertain."""
    best = Window.partitionBy("scene", "sample").orderBy(F.desc("score"), "anchor")
    ranked = found.withColumn("k", F.row_number().over(best))
    top = ranked.where("k = 1").drop("k")
    other = ranked.where("k > 1").select("scene", "sample", F.col("score").alias("o_score"), F.col("forward").alias("o_forward"), F.col("h").alias("o_h"))
    pairs = top.join(other, ["scene", "sample"], "left").withColumn("apart", disagreement(F.col("h"), F.col("o_h"), c))
    sums = pairs.groupBy("scene", "sample", "anchor", "score", "uncertainty").agg(
        F.coalesce(F.bool_or((F.col("score") - F.col("o_score") <= c.rival_score) & (F.col("apart") > c.rival_distance)), F.lit(False)).alias("contested"),
        F.coalesce(F.bool_or((F.col("forward") != F.col("o_forward")) & (F.col("apart") <= c.rival_distance)), F.lit(False)).alias("agreed"),
    )
    u = F.when(F.col("agreed"), F.col("uncertainty") * c.blend_uncertainty).otherwise(F.col("uncertainty"))
    state = F.when(F.col("contested"), "contested").when(F.col("score") < c.least_score, "weak").when(u > c.most_uncertainty, "uncertain").otherwise("accepted")
    return sums.select("scene", "sample", "anchor", "score", u.alias("uncertainty"), state.alias("state"))


def demote_outliers(anchors: DataFrame, scene: str, floor: float, ratio: float, reach: float) -> DataFrame:
    """Automatic anchors (scene, id, t, residual, manual) that are too far off and can be spared.

    From the largest residual down, one over max(floor, ratio * p25) goes if every time covered before
    is still within ``reach`` of an anchor that stays. Each decision depends on the ones before, so a
    scene is folded in one call. Scenes with fewer than three measured automatic anchors keep all.
    """
    kind = lambda x: anchors.schema[x].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        auto = rows[~rows["manual"] & rows["residual"].notna()]
        keep = dict(zip(rows["id"], rows["t"]))
        gone = set()
        if len(auto) >= 3:
            limit = max(floor, float(auto["residual"].quantile(0.25)) * ratio)
            for r in auto.sort_values(["residual", "id"], ascending=[False, True]).itertuples():
                left = [t for i, t in keep.items() if i != r.id]
                if r.residual > limit and left and all(min(abs(t - u) for u in left) <= reach for t in rows["t"]):
                    keep.pop(r.id)
                    gone.add(r.id)
        return pd.DataFrame({scene: rows[scene], "id": rows["id"], "demoted": [i in gone for i in rows["id"]]})

    return anchors.select(scene, "id", "t", "residual", "manual").groupBy(scene).applyInPandas(fold, f"{scene} {kind(scene)}, id {kind('id')}, demoted boolean")


def cross_support(reference: DataFrame, other: DataFrame, tolerance: float = 0.42, most: float = 8.0, least_pairs: int = 3) -> DataFrame:
    """How a second view of one object supports the first: (scene, id, t, x, z) both.

    Each reference row is paired with the nearest other row in time; of the four mirrorings of the
    other view the one with the smallest median distance counts, if that is at most ``most``.
    Gives (scene, pairs, mirror, median) for supported scenes.
    """
    bucket = lambda t: F.floor(t / tolerance)
    o = other.select("scene", F.col("t").alias("ot"), F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("z").alias("oz"), bucket(F.col("t")).alias("b_"))
    near = reference.withColumn("b_", F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)]))).join(o, ["scene", "b_"]).where(F.abs(F.col("t") - F.col("ot")) <= tolerance)
    best = near.groupBy("scene", "id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("ot")).alias("d"), "ot", "oid", "ox", "oz", "x", "z")).alias("m"))
    mirrors = F.explode(F.array(*[F.struct(F.lit(n).alias("mirror"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in ((0, 1, 1), (1, -1, 1), (2, 1, -1), (3, -1, -1))]))
    rows = best.select("scene", "m", mirrors.alias("v"))
    d = F.sqrt(F.pow(F.col("m.x") - F.col("v.a") * F.col("m.ox"), 2) + F.pow(F.col("m.z") - F.col("v.b") * F.col("m.oz"), 2))
    sums = rows.groupBy("scene", F.col("v.mirror").alias("mirror")).agg(F.count("*").alias("pairs"), F.median(d).alias("median"))
    top = sums.groupBy("scene").agg(F.min(F.struct("median", "mirror", "pairs")).alias("b"))
    return top.where((F.col("b.pairs") >= least_pairs) & (F.col("b.median") <= most)).select("scene", F.col("b.pairs").alias("pairs"), F.col("b.mirror").alias("mirror"), F.col("b.median").alias("median"))


def supported_confidence(confidence: Column) -> Column:
    return 1 - 0.75 * (1 - confidence)


def upsert_keyframe(keyframes: DataFrame, edits: DataFrame, by: str, tolerance: float = 0.08) -> DataFrame:
    """Edits (by, t, x, z) replace the nearest keyframe (by, id, t, x, z) within the tolerance, else are added."""
    e = edits.select(by, F.col("t").alias("et"), F.col("x").alias("ex"), F.col("z").alias("ez"))
    hit = e.join(keyframes, by).where(F.abs(F.col("t") - F.col("et")) <= tolerance).groupBy(by, "et").agg(F.min(F.struct(F.abs(F.col("t") - F.col("et")).alias("d"), "t", "id")).alias("m"))
    placed = e.join(hit, [by, "et"], "left").select(by, F.col("m.id").alias("id"), F.col("et").alias("t"), F.col("ex").alias("x"), F.col("ez").alias("z"))
    kept = keyframes.join(placed.where(F.col("id").isNotNull()).select(by, "id"), [by, "id"], "left_anti")
    return kept.select(by, "id", "t", "x", "z").unionByName(placed)
