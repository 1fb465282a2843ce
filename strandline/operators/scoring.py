"""Row-level scoring models: weighted formulas over one (joined) row.

The weights are fixed values of the models.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import clamp


def _share(value: Column, full: float) -> Column:
    return F.least(F.lit(1.0), value / full)


def reid_crop_quality(confidence: Column, width: Column, height: Column, sharpness: Column, clipped: Column) -> Column:
    """Detector confidence, crop size and sharpness, less for a crop cut by the border."""
    area = _share(F.sqrt(F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)), 120.0)
    sharp = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), sharpness)) / F.log1p(F.lit(500.0)))
    return 0.42 * clamp(confidence, 0.0, 1.0) + 0.33 * area + 0.25 * sharp - F.when(clipped, 0.08).otherwise(0.0)


def shirt_crop_quality(confidence: Column, width: Column, height: Column) -> Column:
    """Confidence, height, width and how near the shape is to an upright person's."""
    w, h = F.greatest(F.lit(0.0), width), F.greatest(F.lit(0.0), height)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(w / F.greatest(F.lit(1.0), h) - 0.42) / 0.42)
    return clamp(0.50 * clamp(confidence, 0.0, 1.0) + 0.25 * _share(h, 96.0) + 0.15 * _share(w, 40.0) + 0.10 * shape, 0.0, 1.0)


def camera_motion_confidence(inlier_ratio: Column, inliers: Column, residual: Column, round_trip: Column, coverage: Column) -> Column:
    return 0.30 * _share(inlier_ratio, 0.80) + 0.20 * _share(inliers, 60.0) + 0.20 * F.exp(-residual / 2.5) + 0.20 * F.exp(-round_trip / 1.5) + 0.10 * _share(coverage, 0.12)


def hypothesis_score(confidence: Column, inlier_ratio: Column, path: Column, distance: Column) -> Column:
    """Of a calibration carried over ``distance`` seconds along a path of motion edges; an unknown inlier ratio takes nothing off."""
    anchor = clamp(confidence, 0.0, 1.0) * F.when(inlier_ratio.isNull(), 1.0).otherwise(0.85 + 0.15 * clamp(inlier_ratio, 0.0, 1.0))
    return clamp(anchor * (0.82 + 0.18 * path) * F.exp(-distance / 7.0), 0.0, 0.99)


def hypothesis_uncertainty(anchor: Column, distance: Column, residuals: Column, path: Column) -> Column:
    return F.greatest(F.lit(0.25), anchor + 0.38 * distance + 0.035 * residuals + 3.0 * (1 - path))


def calibration_uncertainty(pixel_error: Column, confidence: Column) -> Column:
    """Metres, from the pixel error where it is known, else from the confidence."""
    return F.bround(F.when(pixel_error.isNotNull(), clamp(pixel_error * 0.25, 0.25, 12.0)).otherwise(clamp(1.0 + (1 - confidence) * 8.0, 0.75, 8.0)), 2)


def pass_relation(cost: Column, start: Column, end: Column, ref_start: Column, ref_end: Column) -> Column:
    """How a pass relates to the reference: the same play again, just before, just after, or neither."""
    return F.when(cost <= 0.07, "replay-overlap").when((ref_start - end).between(-0.15, 0.4), "continuation-before").when((start - ref_end).between(-0.15, 0.4), "continuation-after").otherwise("independent")


def pass_quality(verdict: Column, coverage: Column, gate_score: Column, tracks: Column, ball_samples: Column, frames: Column) -> Column:
    """0 without a verdict; a rejected pass stays below any other."""
    value = F.when(verdict == "pass", 1.0).when(verdict == "review", 0.55).when(verdict == "reject", 0.0).when(verdict == "unknown", 0.15).otherwise(0.1)
    there = 0.55 * _share(tracks, 14.0) + 0.30 * _share(ball_samples, 18.0) + 0.15 * _share(frames, 30.0)
    score = 0.50 * value + 0.25 * F.coalesce(coverage, F.lit(0.0)) + 0.20 * F.coalesce(gate_score, value) + 0.05 * there
    return F.when(F.coalesce(verdict, F.lit("")) == "", 0.0).otherwise(F.bround(F.when(verdict == "reject", F.least(score, F.lit(0.24))).otherwise(score), 3))


def number_decision(best: Column, runner: Column, least: float, margin: float) -> Column:
    """``best`` and ``runner``: structs (number, confidence) of the two strongest numbers, or null."""
    return (
        F.when(best.isNull(), "no-number")
        .when(best["confidence"] < least, "low-confidence")
        .when(runner.isNotNull() & (runner["number"] != best["number"]) & (best["confidence"] - runner["confidence"] <= margin), "ambiguous")
        .otherwise("recognized")
    )


@dataclass(frozen=True)
class EdgeModel:
    """Signals and limits of an identity edge."""

    speed: float = 12.0
    slack: float = 2.0
    accept: float = 0.78
    strong_distance: float = 0.10
    shirt_confidence: float = 0.80


def identity_edge(gap: Column, distance: Column, uncertainty: Column, external: Column, shirt: Column, shirt_confidence: Column, reid: Column, soft_conflicts: Column, model: EdgeModel = EdgeModel()) -> Column:
    """struct(state, score, reasons) of a pair of tracklets.

    ``external`` and ``shirt`` say whether both have one and it is equal (null: unknown); hard
    vetoes are overlap in time, an unreachable place, and known unequal ids or reliable shirts.
    """
    reachable = distance <= model.speed * gap + model.slack + uncertainty
    reliable = shirt_confidence >= model.shirt_confidence
    veto = F.array_compact(
        F.array(F.when(gap < 0, "overlap"), F.when(~reachable, "unreachable"), F.when(~external, "external-id"), F.when(~shirt & reliable, "shirt"))
    )
    strong = F.array_compact(
        F.array(
            F.when(external, F.lit(0.995)),
            F.when(shirt & reliable, 0.94 + F.least(F.lit(0.035), 0.175 * F.greatest(F.lit(0.0), shirt_confidence - 0.8))),
            F.when(reid <= model.strong_distance, 1 - reid),
        )
    )
    weak = F.coalesce(F.greatest(F.when(shirt & ~reliable, F.lit(0.65)), F.when(reid > model.strong_distance, 1 - reid)), F.lit(0.0))
    top = F.greatest(F.coalesce(F.array_max(strong), F.lit(0.0)), weak)
    feasible = F.greatest(F.lit(0.0), 1 - distance / (model.speed * gap + model.slack + uncertainty))
    score = top + F.least(F.lit(0.04), 0.02 * F.greatest(F.size(strong) - 1, F.lit(0))) + 0.015 * feasible - 0.08 * soft_conflicts
    score = F.bround(clamp(score, 0.0, 1.0), 6)
    accepted = (F.size(strong) > 0) & (score >= model.accept) & ((soft_conflicts == 0) | F.coalesce(external, F.lit(False)))
    state = F.when(F.size(veto) > 0, "rejected").when(accepted, "accepted").otherwise("review")
    return F.struct(state.alias("state"), F.when(F.size(veto) == 0, score).alias("score"), veto.alias("reasons"))
