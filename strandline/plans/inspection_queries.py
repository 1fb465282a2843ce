"""Queries of the inspection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import inspection as I
from ..operators import joins as J
from ..sources import proxies as P
from .registry import query

D = "::DOUBLE"

#: Samples of the events' tracks; errors have no place, times are hours for seconds.
STEPS = f"""(SELECT *, CASE WHEN px IS NULL THEN 'unprojected' WHEN speed > 25 THEN 'identity-split' WHEN speed > 14 THEN 'speed-violation' ELSE 'ok' END AS severity FROM (SELECT *, CASE WHEN elapsed > 1e-6{D} THEN delta / elapsed END AS speed
  FROM (SELECT track, frame, t, px, l.frame AS previous_frame, t - l.t AS elapsed, CASE WHEN px IS NOT NULL THEN sqrt((px - l.px) * (px - l.px) + (z - l.z) * (z - l.z)) END AS delta
  FROM (SELECT *, last_value(CASE WHEN px IS NOT NULL THEN {{'frame': frame, 't': t, 'px': px, 'z': z}} END IGNORE NULLS) OVER (PARTITION BY track ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM (SELECT track_id AS track, event_id AS frame, t, CASE WHEN observed THEN x END AS px, z FROM {P.POINTS} WHERE z IS NOT NULL)))))"""


def _steps(spark, sf):
    x = F.when(F.col("observed"), F.col("x"))
    return I.step_samples(P.points(spark, sf).where(F.col("z").isNotNull()).select(F.col("track_id").alias("track"), F.col("event_id").alias("frame"), "t", x.alias("x"), "z"))


@query(f"SELECT track, frame, previous_frame, round(speed, 6) AS speed, severity FROM {STEPS}")
def step_severity(spark, sf):
    return _steps(spark, sf).select("track", "frame", "previous_frame", F.round("speed", 6).alias("speed"), "severity")


@query(f"""SELECT previous_frame % 50 AS previous_frame, frame % 50 AS frame, count(*) AS compared, count(*) FILTER (coalesce(speed, 0) > 14) AS violations, count(*) FILTER (coalesce(speed, 0) > 25) AS splits
  FROM {STEPS} WHERE previous_frame IS NOT NULL GROUP BY 1, 2""")
def population_edges(spark, sf):
    """Events are dealt to 50 frames by their number; each is a track's sample of its own there."""
    steps = _steps(spark, sf).withColumns({"track": F.col("frame"), "previous_frame": F.col("previous_frame") % 50, "frame": F.col("frame") % 50})
    return I.population_edges(steps)


@query(f"""SELECT track, id, round(x + CASE WHEN t - lt > 1e-4{D} THEN (x - lx) / (t - lt) * 0.35{D} ELSE 0 END, 6) AS x, round(z + CASE WHEN t - lt > 1e-4{D} THEN (z - lz) / (t - lt) * 0.35{D} ELSE 0 END, 6) AS z
  FROM (SELECT track_id AS track, event_id AS id, t, x, z, lag(t) OVER w AS lt, lag(x) OVER w AS lx, lag(z) OVER w AS lz FROM {P.POINTS} WINDOW w AS (PARTITION BY track_id ORDER BY t, event_id))""")
def predicted_points(spark, sf):
    points = P.points(spark, sf).select(F.col("track_id").alias("track"), F.col("event_id").alias("id"), "t", "x", "z")
    return I.predicted_points(points, ahead=2.0).select("track", "id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query(f"""SELECT scene, analyzed, metric, ball, track, overlapping, round(least(1, analyzed / 3.0{D}) * 0.25{D} + metric / n * 0.3{D} + ball / n * 0.25{D} + track / n * 0.2{D}, 3) AS evidence FROM (SELECT *, greatest(analyzed, 1)::DOUBLE AS n
  FROM (SELECT o_custkey AS scene, count(*) FILTER (r) AS analyzed, count(*) FILTER (r AND o_orderkey % 3 = 0) AS metric, count(*) FILTER (r AND o_orderkey % 7 >= 3) AS ball, count(*) FILTER (r AND o_orderkey % 11 >= 6) AS track, count(*) FILTER (r AND o_orderkey % 2 = 0) AS overlapping
  FROM (SELECT *, o_orderstatus <> 'P' AS r FROM orders) GROUP BY 1))""")
def pass_consensus(spark, sf):
    key = F.col("o_orderkey")
    verdict, relation = F.when(key % 3 == 0, "pass").otherwise("review"), F.when(key % 2 == 0, "replay-overlap").otherwise("sequence")
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ready")
    return I.consensus(P.read(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), status.alias("status"), verdict.alias("verdict"), (key % 7).alias("balls"), (key % 11).alias("tracks"), relation.alias("relation")))


@query(f"""SELECT frame, id, round(greatest(0, least(1, score * 8)) * least(1, sqrt(x * (y * 40 + 1)) / 180) + CASE WHEN frame % 3 < 2 THEN 0.25{D} ELSE 0 END + CASE WHEN frame % 2 = 0 THEN 0.25{D} ELSE 0 END + CASE frame % 4 WHEN 0 THEN 0.45{D} WHEN 1 THEN 0.18{D} WHEN 2 THEN 0.18{D} ELSE 0 END, 6) AS score FROM {P.BOXES}""")
def observation_scores(spark, sf):
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("frame") % n + 1).cast("int"))
    score = I.observation_score(F.col("score") * 8, F.col("x"), F.col("y") * 40 + 1, pick(3, "usable", "ready", "poor"), pick(2, True, None), pick(4, "recognized", "low-confidence", "ambiguous", None))
    return P.boxes(spark, sf).select("frame", "id", F.round(score, 6).alias("score"))


@query()
def split_partition_crops(spark, sf):
    """Greedy in order of quality: tested against a plain version."""
    points = P.points(spark, sf).select(F.col("track_id").alias("track"), F.col("event_id").alias("id"), F.col("event_id").alias("frame"), "t", (F.col("x") / 4).alias("w"), F.col("x").alias("h"), "conf")
    ranges = P.intervals(spark, sf).select(F.col("owner").alias("track"), F.col("id").alias("number"), (F.col("id") % 600).cast("double").alias("s"), (F.col("id") % 600 + 100).cast("double").alias("e"))
    return I.partition_crops(points, ranges)


@query()
def successor_links(spark, sf):
    """Optimal assignment with no link as a choice: tested against all choices."""
    edges = J.iou_pairs(P.boxes(spark, sf), 0.2).withColumn("iou", F.round("iou", 9))
    return A.successors(edges, "frame", "g_id", "p_id", "iou", 0.47)


@query("""SELECT scene, gain, CASE WHEN gain >= enough AND outside <= enough AND stable >= -1 THEN 'candidate' WHEN gain <= -enough AND outside >= -enough AND stable < 0 THEN 'baseline' ELSE 'review' END AS verdict
  FROM (SELECT o_orderkey AS scene, o_orderkey % 23 - o_orderkey % 19 AS gain, o_custkey % 9 - 4 AS outside, o_orderkey % 5 - 3 AS stable, greatest(3, round_even(greatest(1, o_orderkey % 70) * 0.15::DOUBLE, 0)) AS enough FROM orders)""")
def model_verdicts(spark, sf):
    key = F.col("o_orderkey")
    scenes = P.read(spark, sf, "orders").select(key.alias("scene"), (key % 70).alias("frames"), (key % 19).alias("baseline_inside"), (key % 23).alias("candidate_inside"), (F.col("o_custkey") % 9 - 4).alias("outside_delta"), (key % 5 - 3).alias("stable_delta"))
    return I.model_comparison(scenes)


@query("""SELECT l_orderkey AS run_id, l_linenumber AS line FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = l_orderkey AND o_orderstatus IN ('O', 'P') AND o_custkey % 3 = l_suppkey % 3 AND o_orderkey % 50 > l_quantity)""")
def published_within_fence(spark, sf):
    jobs = P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 3).alias("fingerprint"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 50).alias("expires_at"))
    rows = P.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 3).alias("fingerprint"), F.col("l_quantity").alias("at"), F.col("l_linenumber").alias("line"))
    return I.fenced(rows, jobs, ["O", "P"]).select("run_id", "line")
