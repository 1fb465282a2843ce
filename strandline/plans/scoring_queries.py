"""Queries of the row-level scoring models, over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring as M
from ..sources import proxies as P
from .registry import query

D = "::DOUBLE"


@query(f"""SELECT frame, id, round(0.42{D} * least(1.0, greatest(0.0, c)) + 0.33{D} * least(1.0, sqrt(w * h) / 120) + 0.25{D} * least(1.0, ln(1 + s) / ln(501{D})) - CASE WHEN clipped THEN 0.08{D} ELSE 0 END, 9) AS reid,
  round(0.5{D} * least(1.0, greatest(0.0, c)) + 0.25{D} * least(1.0, h / 96) + 0.15{D} * least(1.0, w / 40) + 0.1{D} * greatest(0.0, 1 - abs(w / greatest(1.0, h) - 0.42{D}) / 0.42{D}), 9) AS shirt
  FROM (SELECT frame, id, score * 10 AS c, x AS w, x + y AS h, score * 1000 AS s, y = 0 AS clipped FROM {P.BOXES})""")
def crop_quality(spark, sf):
    c, w, h = F.col("score") * 10, F.col("x"), F.col("x") + F.col("y")
    reid = M.reid_crop_quality(c, w, h, F.col("score") * 1000, F.col("y") == 0)
    return P.boxes(spark, sf).select("frame", "id", F.round(reid, 9).alias("reid"), F.round(M.shirt_crop_quality(c, w, h), 9).alias("shirt"))


@query(f"""SELECT event_id, round(0.3{D} * least(1.0, conf / 0.8{D}) + 0.2{D} * least(1.0, z / 60) + 0.2{D} * exp(-x / 2.5{D}) + 0.2{D} * exp(-(x / 10) / 1.5{D}) + 0.1{D} * least(1.0, conf / 0.12{D}), 6) AS motion,
  round(least(0.99{D}, greatest(0.0, conf * (0.82{D} + 0.18{D} * (1 - conf)) * exp(-(x / 10) / 7))), 6) AS hypothesis,
  round(greatest(0.25{D}, 1.0 + 0.38{D} * (x / 10) + 0.035{D} * z + 3 * conf), 6) AS uncertainty FROM {P.POINTS}""")
def motion_and_hypothesis(spark, sf):
    conf, x, z = F.col("conf"), F.col("x"), F.col("z")
    return P.points(spark, sf).select(
        "event_id",
        F.round(M.camera_motion_confidence(conf, z, x, x / 10, conf), 6).alias("motion"),
        F.round(M.hypothesis_score(conf, F.lit(None).cast("double"), 1 - conf, x / 10), 6).alias("hypothesis"),
        F.round(M.hypothesis_uncertainty(F.lit(1.0), x / 10, z, 1 - conf), 6).alias("uncertainty"),
    )


@query(f"""SELECT a.owner, a.id AS id, CASE WHEN cost <= 0.07 THEN 'replay-overlap' WHEN rs - e BETWEEN -0.15 AND 0.4 THEN 'continuation-before' WHEN s - re BETWEEN -0.15 AND 0.4 THEN 'continuation-after' ELSE 'independent' END AS relation
  FROM (SELECT *, id % 100 / 100 AS cost, lag(s) OVER (PARTITION BY owner ORDER BY s, id) AS rs, lag(e) OVER (PARTITION BY owner ORDER BY s, id) AS re FROM {P.INTERVALS}) a""")
def pass_relations(spark, sf):
    w = Window.partitionBy("owner").orderBy("s", "id")
    rows = P.intervals(spark, sf).withColumns({"rs": F.lag("s").over(w), "re": F.lag("e").over(w)})
    return rows.select("owner", "id", M.pass_relation(F.col("id") % 100 / 100, F.col("s"), F.col("e"), F.col("rs"), F.col("re")).alias("relation"))


@query(f"""WITH n AS (SELECT tracklet, number, max(conf) AS conf FROM {P.READINGS} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tracklet ORDER BY conf DESC, number) AS k FROM n)
  SELECT a.tracklet, CASE WHEN a.conf < 0.95 THEN 'low-confidence' WHEN b.number IS NOT NULL AND a.conf - b.conf <= 0.01 THEN 'ambiguous' ELSE 'recognized' END AS decision FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b USING (tracklet)""")
def number_decisions(spark, sf):
    n = P.readings(spark, sf).groupBy("tracklet", "number").agg(F.max("conf").alias("confidence"))
    two = n.groupBy("tracklet").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("q"), "number", "confidence"))).alias("r"))
    pick = lambda i: F.try_element_at("r", F.lit(i))
    return two.select("tracklet", M.number_decision(pick(1), pick(2), 0.95, 0.01).alias("decision"))


@query()
def identity_edges(spark, sf):
    w = Window.partitionBy("owner").orderBy("s", "id")
    p = P.intervals(spark, sf).withColumns({"ns": F.lead("s").over(w), "nid": F.lead("id").over(w)}).where(F.col("nid").isNotNull())
    gap = F.col("ns") - F.col("e")
    edge = M.identity_edge(gap, (F.col("id") % 997).cast("double"), F.lit(1.0), F.when(F.col("id") % 11 == 0, F.col("nid") % 2 == 0), F.when(F.col("id") % 3 == 0, F.col("nid") % 3 == 0), F.col("id") % 100 / 100, F.col("nid") % 50 / 100, (F.col("id") % 5 == 0).cast("int"))
    return p.select("owner", "id", "nid", edge.alias("e")).select("owner", "id", "nid", "e.state", "e.score", F.concat_ws(",", "e.reasons").alias("reasons"))
