"""Queries of the operators over time and several passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..sources import proxies as P
from .registry import query


@query()
def anchor_propagation(spark, sf):
    # A scene per track; every fifth point is an anchor, the others ask; an hour stands for a tenth of a second.
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("t", "event_id")
    p = P.points(spark, sf).select(F.col("track_id").alias("scene"), (F.row_number().over(w) - 1).alias("sample"), (F.col("t") / 10).alias("t"), "conf", "x", "observed")
    move = lambda d: F.array(*[F.lit(v) for v in (1.0, 0.0)], d, *[F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    anchors = p.where("sample % 5 = 0").select("scene", "sample", "t", move(F.col("x")).alias("h"), F.lit(0.95).alias("confidence"), F.col("conf").alias("inlier_ratio"), F.lit(0.5).alias("uncertainty"))
    edges = p.select("scene", F.col("sample").alias("at"), move(F.lit(1.0)).alias("h"), move(F.lit(-1.0)).alias("back"), (0.5 + F.col("conf") / 2).alias("confidence"), F.lit(1.0).alias("residual"), F.col("observed").alias("reliable"))
    out = T.propagate(T.hypotheses(p.where("sample % 5 <> 0").select("scene", "sample", "t"), anchors, edges))
    return out.select("scene", "sample", "anchor", F.round("score", 6).alias("score"), F.round("uncertainty", 6).alias("uncertainty"), "state")


@query()
def outlier_anchors(spark, sf):
    a = P.points(spark, sf).select(F.col("track_id").alias("scene"), F.col("event_id").alias("id"), "t", F.col("x").alias("residual"), (F.col("kind") == "signup").alias("manual"))
    return T.demote_outliers(a, "scene", 5.0, 2.0, 24.0)


@query(f"""WITH r AS (SELECT track_id AS scene, event_id AS id, t, x, z - 50 AS z FROM {P.POINTS} WHERE kind = 'click'), o AS (SELECT track_id AS scene, event_id AS oid, t AS ot, x AS ox, z - 50 AS oz FROM {P.POINTS} WHERE kind = 'view'),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY abs(t - ot), ot, oid) AS k FROM r JOIN o USING (scene) WHERE abs(t - ot) <= 8) WHERE k = 1),
  m AS (SELECT scene, mirror, count(*) AS pairs, median(sqrt((x - a * ox) * (x - a * ox) + (z - b * oz) * (z - b * oz))) AS median FROM n, (VALUES (0, 1, 1), (1, -1, 1), (2, 1, -1), (3, -1, -1)) v(mirror, a, b) GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY median, mirror) AS k FROM m)
  SELECT scene, pairs, mirror, round(median, 6) AS median FROM k WHERE k = 1 AND pairs >= 3 AND median <= 30""")
def cross_view_support(spark, sf):
    p = P.points(spark, sf).select(F.col("track_id").alias("scene"), F.col("event_id").alias("id"), "t", "x", (F.col("z") - 50).alias("z"), "kind")
    return T.cross_support(p.where("kind = 'click'").drop("kind"), p.where("kind = 'view'").drop("kind"), 8.0, 30.0).withColumn("median", F.round("median", 6))
