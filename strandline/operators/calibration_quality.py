"""How good calibrations are: the gates of one frame, and what a shot's frames come to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import determinant
from ..functions.numeric import clamp, higher_is_better, let, lower_is_better


@dataclass(frozen=True)
class FrameGates:
    """Limits are fixed values."""

    confidence: float = 0.75
    residual_p95: float = 15.0
    keypoints: int = 6
    inlier_ratio: float = 0.65
    #: A view of a part only: larger residuals at the rim are taken where the middle is good.
    partial_p95: float = 25.0
    partial_p50: float = 8.0
    f1: float = 0.08
    partial_f1: float = 0.15
    partial_line_p95: float = 20.0
    partial_line_p50: float = 5.0


def inlier_share(frame: Column) -> Column:
    """The ratio told, else inliers over keypoints; within 0..1, null where neither is known."""
    told = F.coalesce(frame["inlier_ratio"], F.try_divide(frame["inliers"].cast("double"), frame["keypoints"].cast("double")))
    return clamp(told, 0.0, 1.0)


def frame_failures(frame: Column, g: FrameGates = FrameGates()) -> Column:
    """All reasons against one directly observed calibration, in order; an empty array: accepted.

    ``frame``: a struct of h, confidence, keypoints, inliers, inlier_ratio, residual, residual_p95, f1, line_p50,
    line_p95, manual. A manual one is not asked for confidence, keypoints and lines. A residual that is
    not known is no reason; lines that are not scored are one.
    """
    h, manual = frame["h"], F.coalesce(frame["manual"], F.lit(False))
    finite = F.coalesce((F.size(h) == 9) & F.forall(h, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    single = finite & (F.abs(F.when(finite, determinant(h))) < 1e-10)
    yes = lambda c: F.coalesce(c, F.lit(False))
    share, p95 = inlier_share(frame), F.coalesce(frame["residual_p95"], frame["residual"])
    partial = ~manual & yes((p95 <= g.partial_p95) & (frame["residual"] <= g.partial_p50) & (frame["keypoints"] >= g.keypoints) & (share >= g.inlier_ratio))
    lines = yes((frame["line_p95"] <= g.residual_p95) & (frame["f1"] >= g.f1)) | yes((frame["line_p95"] <= g.partial_line_p95) & (frame["line_p50"] <= g.partial_line_p50) & (frame["f1"] >= g.partial_f1))
    return F.array_compact(
        F.array(
            F.when(~finite, "invalid-homography"),
            F.when(single, "singular-homography"),
            F.when(~manual & ~yes(frame["confidence"] >= g.confidence), "confidence-below-metric-threshold"),
            F.when(yes(p95 > g.residual_p95) & ~partial, "reprojection-error-too-high"),
            F.when(~manual & frame["f1"].isNull(), "semantic-line-alignment-unscored").when(~manual & ~lines, "semantic-line-alignment-poor"),
            F.when(~manual & ~yes(frame["keypoints"] >= g.keypoints), "insufficient-detected-keypoints"),
            F.when(~manual & ~yes(share >= g.inlier_ratio), "insufficient-keypoint-inlier-ratio"),
        )
    )


def shot_summary(evidence: DataFrame) -> DataFrame:
    """One row per scene of its frames' calibrations.

    ``evidence``: scene, sample, t, status (accepted, rejected, missing), source, ambiguous, uncertainty, residual,
    residual_p95, f1, side, anchor (of a temporal one), motion. Shares are of all frames; the largest gap counts from the scene's first
    frame and to its last; sides are voted by direct frames, without any by one accepted frame of each anchor
    (or source); percentiles are of accepted frames, the uncertainty's of temporal ones.
    """
    accepted = F.coalesce(F.col("status") == "accepted", F.lit(False))
    direct = accepted & F.coalesce(F.col("source").isin("direct", "manual-direct"), F.lit(False))
    temporal = accepted & F.coalesce(F.col("source").startswith("temporal-"), F.lit(False))
    order = Window.partitionBy("scene").orderBy("t", "sample")
    rows = evidence.withColumns({"ok": accepted, "direct": direct, "temporal": temporal}).withColumn("before", F.last(F.when(F.col("ok"), F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    vote = Window.partitionBy("scene", "ok", F.coalesce(F.col("anchor").cast("string"), F.col("source"), F.lit("unknown"))).orderBy("t", "sample")
    rows = rows.withColumn("first_of_anchor", F.col("ok") & (F.row_number().over(vote) == 1))
    count = F.count("*")
    share = lambda c: F.round(F.count_if(c) / count, 3)
    when = lambda c, v: F.when(F.col(c), v)
    side = lambda of, name: F.count_if(F.col(of) & (F.col("side") == name))
    tracked = F.col("motion").isin("estimated", "unreliable")
    s = rows.groupBy("scene").agg(
        count.alias("frames"), *(F.count_if(F.col("status") == x).alias(x) for x in ("accepted", "rejected", "missing")), F.count_if("direct").alias("direct"), F.count_if("temporal").alias("temporal"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
        share(F.col("ok")).alias("coverage"), share(F.col("direct")).alias("direct_coverage"),
        F.round(F.greatest(F.max(when("ok", F.col("t") - F.coalesce("before", F.col("t")))), F.min(when("ok", F.col("t"))) - F.min("t"), F.max("t") - F.coalesce(F.max(when("ok", F.col("t"))), F.min("t"))), 3).alias("max_gap"),
        F.round(F.percentile(when("ok", F.col("residual")), F.lit(0.5)), 3).alias("residual_p50"), F.round(F.percentile(when("ok", F.coalesce("residual_p95", "residual")), F.lit(0.95)), 3).alias("residual_p95"),
        F.round(F.percentile(when("ok", F.col("f1")), F.lit(0.1)), 3).alias("f1_p10"), F.round(F.percentile(when("temporal", F.col("uncertainty")), F.lit(0.95)), 3).alias("uncertainty_p95"),
        F.round(F.try_divide(F.count_if(F.col("motion") == "estimated").cast("double"), F.count_if(tracked).cast("double")), 3).alias("motion_share"), F.count_if(F.col("motion") == "cut").alias("cuts"),
        side("direct", "left").alias("dl"), side("direct", "right").alias("dr"), side("first_of_anchor", "left").alias("al"), side("first_of_anchor", "right").alias("ar"),
    )
    use = F.col("direct") > 0
    left, right = F.when(use, F.col("dl")).otherwise(F.col("al")), F.when(use, F.col("dr")).otherwise(F.col("ar"))
    s = s.withColumns({"left": left, "right": right}).drop("dl", "dr", "al", "ar")
    seen = F.col("left") + F.col("right")
    return s.withColumns({"side": F.when(seen > 0, F.when(F.col("left") >= F.col("right"), "left").otherwise("right")), "side_agreement": F.round(F.try_divide(F.greatest("left", "right").cast("double"), seen.cast("double")), 3)})


def shot_verdicts(summary: DataFrame) -> DataFrame:
    """Gates of ``shot_summary``: (scene, coverage, max_gap, residual_p95, side_agreement, uncertainty), each pass, review, reject or
    unknown, and the worst as ``verdict`` (unknown counts as review). Scenes without temporal frames have no uncertainty to judge."""
    gates = {
        "coverage": higher_is_better(F.col("coverage"), 0.90, 0.75), "max_gap": lower_is_better(F.col("max_gap"), 0.60, 1.00), "residual_p95": lower_is_better(F.col("residual_p95"), 8.0, 20.0),
        "side_agreement": higher_is_better(F.col("side_agreement"), 0.90, 0.80), "uncertainty": F.when(F.col("temporal") == 0, "pass").otherwise(lower_is_better(F.col("uncertainty_p95"), 2.5, 5.0)),
    }
    told = F.array(*gates.values())
    worst = let(told, lambda v: F.when(F.array_contains(v, "reject"), "reject").when(F.array_contains(v, "review") | F.array_contains(v, "unknown"), "review").otherwise("pass"))
    return summary.select("scene", *(v.alias(k) for k, v in gates.items()), worst.alias("verdict"))
