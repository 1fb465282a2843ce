"""Queries of scans and retries: a track's events are the frames of a scene, an order's lines its attempts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import scans as S
from ..sources import proxies as P
from .registry import query

_FRAMES = f"""(SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS frame, event_id % 17 = 0 AS cut, event_id % 4 AS regions, kind <> 'error' OR event_id % 3 = 0 AS works,
  event_id % 5 > 0 AS roi_hit, event_id % 6 > 1 AS global_hit, event_id % 2 = 0 AS other_hit, 8 + event_id % 3 AS tiles FROM {P.POINTS})"""

_MODES = f"""WITH RECURSIVE f AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM {_FRAMES}),
  s AS (SELECT track_id, -1::BIGINT AS frame, ''::VARCHAR AS mode, ''::VARCHAR AS reason, ''::VARCHAR AS circuit, false AS hit, false AS open, 0 AS wait FROM f WHERE frame = 0 UNION ALL
    SELECT f.track_id, f.frame, CASE WHEN (s.open AND s.wait > 0) OR NOT works THEN 'other' WHEN whole IS NOT NULL THEN 'global' WHEN roi_hit THEN 'roi' ELSE 'reacquire' END,
      CASE WHEN s.open AND s.wait > 0 THEN 'circuit' WHEN NOT works THEN 'failure' WHEN whole IS NOT NULL THEN whole WHEN NOT roi_hit THEN 'region-miss' END,
      CASE WHEN s.open AND s.wait > 0 THEN 'open' WHEN NOT works THEN CASE WHEN s.open THEN 'trial-failed' ELSE 'opened' END WHEN s.open THEN 'trial-closed' ELSE 'closed' END,
      CASE WHEN (s.open AND s.wait > 0) OR NOT works THEN other_hit WHEN whole IS NOT NULL THEN global_hit ELSE roi_hit OR global_hit END,
      (s.open AND s.wait > 0) OR NOT works, CASE WHEN s.open AND s.wait > 0 THEN s.wait - 1 ELSE 5 END
    FROM s JOIN f ON f.track_id = s.track_id AND f.frame = s.frame + 1,
      LATERAL (SELECT CASE WHEN f.cut THEN 'cut' WHEN f.frame = 0 THEN 'first' WHEN f.frame = f.n - 1 THEN 'last' WHEN f.frame % 10 = 0 THEN 'periodic' WHEN NOT s.hit THEN 'nothing-before' WHEN f.regions = 0 THEN 'no-region' END AS whole))"""


def frames(spark, sf):
    p = P.points(spark, sf)
    w = Window.partitionBy("track_id").orderBy("t", "event_id")
    return p.select("track_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), *(F.expr(v).alias(k) for k, v in {"cut": "event_id % 17 = 0", "regions": "event_id % 4", "works": "kind <> 'error' OR event_id % 3 = 0", "roi_hit": "event_id % 5 > 0", "global_hit": "event_id % 6 > 1", "other_hit": "event_id % 2 = 0", "tiles": "8 + event_id % 3"}.items()))


@query(f"{_MODES} SELECT track_id, frame, mode, coalesce(reason, '') AS reason, circuit, hit FROM s WHERE frame >= 0")
def scan_modes(spark, sf):
    return S.scan_modes(frames(spark, sf), "track_id").withColumn("reason", F.coalesce("reason", F.lit("")))


@query(f"""{_MODES}, c AS (SELECT s.track_id, count(*) AS frames, count(*) FILTER (mode = 'global') AS "global", count(*) FILTER (mode = 'roi') AS roi, count(*) FILTER (mode = 'reacquire') AS reacquire, count(*) FILTER (mode = 'other') AS other,
    coalesce(sum(tiles) FILTER (mode IN ('global', 'reacquire')), 0)::BIGINT AS global_crops, coalesce(sum(regions) FILTER (mode IN ('roi', 'reacquire')), 0)::BIGINT AS roi_crops, coalesce(max(tiles) FILTER (mode IN ('global', 'reacquire')), 0)::BIGINT AS largest
    FROM s JOIN f ON f.track_id = s.track_id AND f.frame = s.frame GROUP BY s.track_id)
  SELECT track_id, frames, "global", roi, reacquire, other, global_crops, roi_crops, largest * frames AS every_crops, CASE WHEN largest > 0 THEN round(1 - (global_crops + roi_crops)::DOUBLE / (largest * frames), 4) END AS saved FROM c""")
def scan_costs(spark, sf):
    f = frames(spark, sf)
    return S.crop_costs(S.scan_modes(f, "track_id"), f, "track_id")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber - 1 AS round, l_quantity > 35 AS accepted, l_suppkey % 4 AS reasons, CASE WHEN l_tax > 0 THEN l_discount END AS residual FROM lineitem WHERE l_linenumber <= 3),
  b AS (SELECT *, coalesce(bool_or(accepted) OVER (PARTITION BY l_orderkey ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM a)
  SELECT l_orderkey, round::INT AS round, accepted, residual, tries FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS tries, row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT accepted, CASE WHEN accepted THEN 0 ELSE reasons END, CASE WHEN accepted THEN 0 ELSE coalesce(residual, 'Infinity'::DOUBLE) END, round, residual NULLS FIRST) AS k
    FROM b WHERE NOT done) WHERE k = 1""")
def retry_rounds(spark, sf):
    lines = P.read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("k"), (F.col("l_quantity") > 35).alias("accepted"), (F.col("l_suppkey") % 4).alias("reasons"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("residual"))
    solve = lambda pending, k: lines.where(F.col("k") == k).drop("k").join(pending, "l_orderkey", "left_semi")
    return S.settled(S.retried(lines.select("l_orderkey").distinct(), "l_orderkey", solve), "l_orderkey")
