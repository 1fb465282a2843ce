"""Queries of calibration quality: a track's events are the frames of a shot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration_quality as C
from ..sources import proxies as P
from .registry import query

_FRAMES = f"""(SELECT track_id AS scene, event_id AS sample, t, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN track_id % 4 = 0 OR event_id % 3 > 0 THEN 'temporal-forward' ELSE 'direct' END AS source, event_id % 13 = 0 AS ambiguous,
  CASE WHEN event_id % 6 > 0 THEN x * 0.02531 END AS uncertainty, CASE WHEN event_id % 8 > 0 THEN x * 0.10193 END AS residual, CASE WHEN event_id % 4 > 0 THEN x * 0.12371 END AS residual_p95, CASE WHEN event_id % 9 > 0 THEN conf END AS f1, CASE event_id % 5 WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'left' END AS side,
  CASE WHEN event_id % 10 > 0 THEN event_id // 50 END AS anchor, CASE event_id % 6 WHEN 0 THEN 'cut' WHEN 1 THEN 'unreliable' ELSE 'estimated' END AS motion FROM {P.POINTS})"""


def frames(spark, sf):
    e = {
        "status": "CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END", "source": "if(track_id % 4 = 0 OR event_id % 3 > 0, 'temporal-forward', 'direct')", "ambiguous": "event_id % 13 = 0", "uncertainty": "if(event_id % 6 > 0, x * 0.02531D, null)",
        "residual": "if(event_id % 8 > 0, x * 0.10193D, null)", "residual_p95": "if(event_id % 4 > 0, x * 0.12371D, null)", "f1": "if(event_id % 9 > 0, conf, null)", "side": "CASE event_id % 5 WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'left' END",
        "anchor": "if(event_id % 10 > 0, event_id div 50, null)", "motion": "CASE event_id % 6 WHEN 0 THEN 'cut' WHEN 1 THEN 'unreliable' ELSE 'estimated' END",
    }
    return P.points(spark, sf).select(F.col("track_id").alias("scene"), F.col("event_id").alias("sample"), "t", *(F.expr(v).alias(k) for k, v in e.items()))


_SUMMARY = f"""r AS (SELECT *, status = 'accepted' AS ok, status = 'accepted' AND source = 'direct' AS direct, status = 'accepted' AND source LIKE 'temporal-%' AS temporal FROM {_FRAMES}),
  v AS (SELECT *, max(t) FILTER (ok) OVER (PARTITION BY scene ORDER BY t, sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, ok AND row_number() OVER (PARTITION BY scene, ok, coalesce(anchor::VARCHAR, source) ORDER BY t, sample) = 1 AS voter FROM r),
  s AS (SELECT scene, count(*) AS frames, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (direct) AS direct, count(*) FILTER (temporal) AS temporal, count(*) FILTER (ambiguous) AS ambiguous,
    round(count(*) FILTER (ok) / count(*), 3) AS coverage, round(count(*) FILTER (direct) / count(*), 3) AS direct_coverage, round(greatest(max(t - coalesce(before, t)) FILTER (ok), min(t) FILTER (ok) - min(t), max(t) - coalesce(max(t) FILTER (ok), min(t))), 3) AS max_gap,
    round(quantile_cont(residual, 0.5) FILTER (ok), 3) AS residual_p50, round(quantile_cont(coalesce(residual_p95, residual), 0.95) FILTER (ok), 3) AS residual_p95, round(quantile_cont(f1, 0.1) FILTER (ok), 3) AS f1_p10, round(quantile_cont(uncertainty, 0.95) FILTER (temporal), 3) AS uncertainty_p95,
    round(count(*) FILTER (motion = 'estimated') / nullif(count(*) FILTER (motion <> 'cut'), 0), 3) AS motion_share, count(*) FILTER (motion = 'cut') AS cuts,
    CASE WHEN count(*) FILTER (direct) > 0 THEN count(*) FILTER (direct AND side = 'left') ELSE count(*) FILTER (voter AND side = 'left') END AS "left", CASE WHEN count(*) FILTER (direct) > 0 THEN count(*) FILTER (direct AND side = 'right') ELSE count(*) FILTER (voter AND side = 'right') END AS "right" FROM v GROUP BY scene),
  f AS (SELECT *, CASE WHEN "left" + "right" > 0 THEN CASE WHEN "left" >= "right" THEN 'left' ELSE 'right' END END AS side, round(greatest("left", "right") / nullif("left" + "right", 0), 3) AS side_agreement FROM s)"""


@query(f"WITH {_SUMMARY} SELECT * FROM f")
def calibration_shots(spark, sf):
    return C.shot_summary(frames(spark, sf))


def _gate(c: str, good: float, fair: float, higher: bool) -> str:
    op = ">=" if higher else "<="
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} {op} {good} THEN 'pass' WHEN {c} {op} {fair} THEN 'review' ELSE 'reject' END"


@query(f"""WITH {_SUMMARY}, g AS (SELECT scene, {_gate('coverage', 0.9, 0.75, True)} AS coverage, {_gate('max_gap', 0.6, 1.0, False)} AS max_gap, {_gate('residual_p95', 8, 20, False)} AS residual_p95, {_gate('side_agreement', 0.9, 0.8, True)} AS side_agreement,
    CASE WHEN temporal = 0 THEN 'pass' ELSE {_gate('uncertainty_p95', 2.5, 5, False)} END AS uncertainty FROM f)
  SELECT *, CASE WHEN 'reject' IN (coverage, max_gap, residual_p95, side_agreement, uncertainty) THEN 'reject' WHEN 'review' IN (coverage, max_gap, residual_p95, side_agreement, uncertainty) OR 'unknown' IN (coverage, max_gap, residual_p95, side_agreement, uncertainty) THEN 'review' ELSE 'pass' END AS verdict FROM g""")
def calibration_shot_verdicts(spark, sf):
    return C.shot_verdicts(C.shot_summary(frames(spark, sf)))


_GATED = f"""(SELECT event_id, event_id % 17 = 0 AS bad, event_id % 19 = 0 AS single, CASE WHEN event_id % 12 > 0 THEN conf END AS confidence, event_id % 14 AS keypoints, event_id % 9 AS inliers, CASE WHEN event_id % 4 = 0 THEN conf END AS inlier_ratio, CASE WHEN event_id % 10 > 0 THEN x / 12 END AS residual,
  CASE WHEN event_id % 3 > 0 THEN x / 5 END AS residual_p95, CASE WHEN event_id % 8 > 0 THEN conf / 3 END AS f1, x / 15 AS line_p50, x / 6 AS line_p95, event_id % 11 = 0 AS manual FROM {P.POINTS})"""


@query(f"""WITH s AS (SELECT *, least(1.0, greatest(0.0, coalesce(inlier_ratio, inliers / nullif(keypoints, 0)))) AS share, coalesce(residual_p95, residual) AS p95 FROM {_GATED}),
  p AS (SELECT *, CASE WHEN inlier_ratio IS NULL AND keypoints = 0 THEN NULL ELSE share END AS ratio FROM s)
  SELECT event_id, concat_ws(',', CASE WHEN bad THEN 'invalid-homography' END, CASE WHEN NOT bad AND single THEN 'singular-homography' END, CASE WHEN NOT manual AND coalesce(confidence < 0.75, true) THEN 'confidence-below-metric-threshold' END,
    CASE WHEN p95 > 15 AND NOT (NOT manual AND coalesce(p95 <= 25 AND residual <= 8 AND keypoints >= 6 AND ratio >= 0.65, false)) THEN 'reprojection-error-too-high' END,
    CASE WHEN NOT manual AND f1 IS NULL THEN 'semantic-line-alignment-unscored' WHEN NOT manual AND NOT ((line_p95 <= 15 AND f1 >= 0.08) OR (line_p95 <= 20 AND line_p50 <= 5 AND f1 >= 0.15)) THEN 'semantic-line-alignment-poor' END,
    CASE WHEN NOT manual AND keypoints < 6 THEN 'insufficient-detected-keypoints' END, CASE WHEN NOT manual AND NOT coalesce(ratio >= 0.65, false) THEN 'insufficient-keypoint-inlier-ratio' END) AS reasons FROM p""")
def frame_calibration_gates(spark, sf):
    h = F.when(F.col("event_id") % 17 == 0, F.array(*(F.lit(float("nan") if k == 4 else 1.0) for k in range(9)))).when(F.col("event_id") % 19 == 0, F.array(*(F.lit(1.0) for _ in range(9)))).otherwise(F.array(*(F.lit(2.0 if k % 4 == 0 else 0.0) for k in range(9))))
    e = {
        "confidence": "if(event_id % 12 > 0, conf, null)", "keypoints": "event_id % 14", "inliers": "event_id % 9", "inlier_ratio": "if(event_id % 4 = 0, conf, null)", "residual": "if(event_id % 10 > 0, x / 12, null)", "residual_p95": "if(event_id % 3 > 0, x / 5, null)",
        "f1": "if(event_id % 8 > 0, conf / 3, null)", "line_p50": "x / 15", "line_p95": "x / 6", "manual": "event_id % 11 = 0",
    }
    p = P.points(spark, sf).select("event_id", F.struct(h.alias("h"), *(F.expr(v).alias(k) for k, v in e.items())).alias("frame"))
    return p.select("event_id", F.concat_ws(",", C.frame_failures(F.col("frame"))).alias("reasons"))
