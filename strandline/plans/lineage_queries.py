"""Queries of the correction and calibration lineage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..sources import proxies as P
from .registry import query


@query(f"""SELECT track, rt, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY track, rt ORDER BY annotated DESC, conf DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY track, rt) AS n FROM (
  SELECT event_id, track_id % 10 AS track, floor(t * 10 + 0.5) / 10 AS rt, conf, kind = 'signup' AS annotated FROM {P.POINTS})) WHERE k = 1""")
def merge_by_time(spark, sf):
    p = P.points(spark, sf).withColumn("annotated", F.col("kind") == "signup")
    return L.merge_points(p, F.col("track_id") % 10, 1)


_SPLITS = "(SELECT o_custkey AS track_id, min(o_orderkey % 600)::DOUBLE AS start, min(o_orderkey % 600)::DOUBLE + 100 AS stop, -o_custkey AS new_id FROM orders GROUP BY 1)"


@query(f"SELECT event_id, coalesce(new_id, p.track_id) AS new_track FROM {P.POINTS} p LEFT JOIN {_SPLITS} s ON p.track_id = s.track_id AND s.start <= t AND t < s.stop")
def split_reassignment(spark, sf):
    s = P.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("track_id")).agg(F.min(F.col("o_orderkey") % 600).cast("double").alias("start"))
    splits = s.select("track_id", "start", (F.col("start") + 100).alias("stop"), (-F.col("track_id")).alias("new_id"))
    return L.split_tracks(P.points(spark, sf), splits).select("event_id", "new_track")


@query("""SELECT l_orderkey, attempt, status_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY status_rank DESC, reasons, residual, confidence DESC, inliers DESC, attempt) AS k FROM (
  SELECT l_orderkey, l_partkey * 10 + l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS status_rank, l_linenumber AS reasons, l_discount AS residual, l_tax AS confidence, l_quantity AS inliers FROM lineitem)) WHERE k = 1""")
def best_attempts(spark, sf):
    rank = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    a = P.read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("attempt"), rank.alias("status_rank"), F.col("l_linenumber").alias("reasons"), F.col("l_discount").alias("residual"), F.col("l_tax").alias("confidence"), F.col("l_quantity").alias("inliers"))
    return L.best_attempt(a, "l_orderkey")


@query(f"""SELECT DISTINCT s.event_id AS id FROM {P.POINTS} s JOIN (SELECT track_id, t FROM {P.POINTS} WHERE kind = 'purchase') a ON s.track_id = a.track_id AND abs(s.t - a.t) <= 4
  WHERE NOT EXISTS (SELECT 1 FROM {P.POINTS} d WHERE d.kind = 'purchase' AND d.track_id = s.track_id AND d.t = s.t)""")
def affected_by_edit(spark, sf):
    p = P.points(spark, sf)
    return L.affected_samples(p.select(F.col("event_id").alias("id"), "track_id", "t"), p.where("kind = 'purchase'").select("track_id", "t"), "track_id", 4.0)


@query(f"""WITH f AS (SELECT event_id AS id, track_id, t FROM {P.POINTS} WHERE kind = 'click'), s AS (SELECT event_id, track_id, t, conf >= 0.3 AS accepted FROM {P.POINTS} WHERE kind = 'view'),
  a AS (SELECT id, max_by(struct_pack(t := s.t, ok := accepted), struct_pack(t := s.t, e := event_id)) AS a FROM f JOIN s ON f.track_id = s.track_id AND s.t <= f.t GROUP BY id),
  b AS (SELECT id, min_by(struct_pack(t := s.t, ok := accepted), struct_pack(t := s.t, e := event_id)) AS b FROM f JOIN s ON f.track_id = s.track_id AND s.t > f.t GROUP BY id),
  r AS (SELECT id, f.t, a, b, CASE WHEN abs(f.t - a.t) <= 1e-6 THEN 'exact' WHEN a IS NULL OR b IS NULL THEN 'outside-bracket' WHEN b.t - a.t > 30 THEN 'interval-too-long' WHEN NOT (a.ok AND b.ok) THEN 'end-not-accepted' ELSE 'interpolated' END AS reason
    FROM f LEFT JOIN a USING (id) LEFT JOIN b USING (id)) SELECT id, reason, CASE WHEN reason = 'interpolated' THEN round((t - a.t) / (b.t - a.t), 6) END AS alpha FROM r""")
def dense_frame_context(spark, sf):
    p = P.points(spark, sf)
    frames = p.where("kind = 'click'").select(F.col("event_id").alias("id"), "track_id", "t")
    samples = p.where("kind = 'view'").select("track_id", "t", (F.col("conf") >= 0.3).alias("accepted"))
    return L.dense_context(frames, samples, "track_id", L.ContextConfig(interval=30.0)).withColumn("alpha", F.round("alpha", 6))
