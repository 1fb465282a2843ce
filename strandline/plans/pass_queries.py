"""Queries over several passes: customers are people seen in passes, orders the segments of an owner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import passes as M
from ..operators import quality as Q
from ..sources import proxies as P
from .registry import query

_PASSES = """(SELECT DISTINCT c_nationkey AS match, c_custkey % 4 AS pass, c_custkey % 4 AS seq, (c_nationkey * 3 + c_custkey % 4 * 2) % 5 / 5.0::DOUBLE AS quality, (c_nationkey + c_custkey % 4) % 5 > 0 AS overlap,
  0.45::DOUBLE + (c_nationkey * 7 + c_custkey % 4) % 6 / 10.0::DOUBLE AS confidence, c_nationkey % 3 = 0 AS manual, (c_nationkey + c_custkey % 4) % 7 AS anchors FROM customer)"""
_PEOPLE = """(SELECT c_nationkey AS match, c_custkey % 4 AS pass, c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 4 % 2 END AS team, CASE WHEN c_custkey % 5 > 0 THEN 'player' WHEN c_custkey % 35 = 0 THEN 'keeper' END AS role,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey // 7 % 9 END AS external, CASE WHEN c_custkey % 8 > 0 THEN c_custkey // 5 % 11 END AS number, c_custkey % 29 = 0 AS conflict FROM customer)"""
_FUSED = f"""ref AS (SELECT match, arg_min(pass, (-quality, seq, pass)) AS reference FROM passes GROUP BY match),
  al AS (SELECT match, pass FROM passes JOIN ref USING (match) WHERE pass <> reference AND overlap AND confidence >= CASE WHEN manual THEN 0.5::DOUBLE ELSE 0.65::DOUBLE END AND anchors >= 2),
  l AS (SELECT a.match, a.pass, a.id, r.id AS r_id, CASE WHEN a.external = r.external THEN 1.0 ELSE 0.9 END::DOUBLE AS score, concat_ws(',', CASE WHEN a.external = r.external THEN 'external-player-match' END, CASE WHEN a.number = r.number THEN 'reliable-jersey-match' END) AS signals
    FROM people a JOIN al USING (match, pass) JOIN ref USING (match) JOIN people r ON r.match = a.match AND r.pass = reference WHERE NOT a.conflict AND NOT r.conflict AND coalesce(a.team = r.team, true) AND coalesce(a.role = r.role, true) AND coalesce(a.number = r.number, true)
      AND (a.external = r.external OR (a.external IS NULL AND r.external IS NULL AND a.number = r.number))),
  b AS (SELECT *, max(score) OVER (PARTITION BY match, pass, id) AS ba, max(score) OVER (PARTITION BY match, pass, r_id) AS br FROM l),
  n AS (SELECT *, count(*) FILTER (ba - score < 0.08) OVER (PARTITION BY match, pass, id) AS na, count(*) FILTER (br - score < 0.08) OVER (PARTITION BY match, pass, r_id) AS nr FROM b),
  t AS (SELECT match, pass, id, max(r_id) FILTER (score = ba AND score = br AND na = 1 AND nr = 1) AS r_id, max(score) FILTER (score = ba AND score = br AND na = 1 AND nr = 1) AS score, max(signals) FILTER (score = ba AND score = br AND na = 1 AND nr = 1) AS signals FROM n GROUP BY ALL),
  f AS (SELECT p.match, p.pass, p.id, CASE WHEN p.pass = reference THEN p.id::VARCHAR WHEN r_id IS NOT NULL THEN r_id::VARCHAR ELSE 'angle-' || substr(sha256(p.pass::VARCHAR), 1, 10) || ':person:' || p.id END AS fused,
    CASE WHEN p.pass = reference THEN 'reference' WHEN al.pass IS NULL THEN 'unaligned' WHEN r_id IS NOT NULL THEN 'linked' WHEN t.id IS NOT NULL THEN 'review' ELSE 'alone' END AS state, score, signals
    FROM people p JOIN ref USING (match) LEFT JOIN al ON al.match = p.match AND al.pass = p.pass LEFT JOIN t ON t.match = p.match AND t.pass = p.pass AND t.id = p.id)"""


def passes(spark, sf):
    return P.read(spark, sf, "customer").selectExpr(
        "c_nationkey AS match", "c_custkey % 4 AS pass", "c_custkey % 4 AS seq", "(c_nationkey * 3 + c_custkey % 4 * 2) % 5 / 5D AS quality", "(c_nationkey + c_custkey % 4) % 5 > 0 AS overlap",
        "0.45D + (c_nationkey * 7 + c_custkey % 4) % 6 / 10D AS confidence", "c_nationkey % 3 = 0 AS manual", "(c_nationkey + c_custkey % 4) % 7 AS anchors",
    ).distinct()


def people(spark, sf):
    return P.read(spark, sf, "customer").selectExpr(
        "c_nationkey AS match", "c_custkey % 4 AS pass", "c_custkey AS id", "if(c_custkey % 3 > 0, c_custkey div 4 % 2, null) AS team", "CASE WHEN c_custkey % 5 > 0 THEN 'player' WHEN c_custkey % 35 = 0 THEN 'keeper' END AS role",
        "if(c_custkey % 6 = 0, c_custkey div 7 % 9, null) AS external", "if(c_custkey % 8 > 0, c_custkey div 5 % 11, null) AS number", "c_custkey % 29 = 0 AS conflict",
    )


@query(f"WITH passes AS {_PASSES}, people AS {_PEOPLE}, {_FUSED} SELECT match, pass, id, fused, state, coalesce(score, 0) AS score, coalesce(signals, '') AS signals FROM f")
def fused_people(spark, sf):
    return M.fuse_passes(people(spark, sf), passes(spark, sf)).withColumns({"score": F.coalesce("score", F.lit(0.0)), "signals": F.coalesce("signals", F.lit(""))})


@query(f"""WITH passes AS {_PASSES}, people AS {_PEOPLE}, {_FUSED}
  SELECT match, reference, quality, passes, aligned, people, identities, linked, review FROM (SELECT match, any_value(reference) AS reference, max(quality) AS quality, count(*) AS passes, count(*) FILTER ((match, pass) IN (SELECT match, pass FROM al)) AS aligned FROM passes JOIN ref USING (match) GROUP BY match)
  JOIN (SELECT match, count(*) AS people, count(DISTINCT fused) AS identities, count(*) FILTER (state = 'linked') AS linked, count(*) FILTER (state = 'review') AS review FROM f GROUP BY match) USING (match)""")
def finalized_passes(spark, sf):
    p, s = people(spark, sf), passes(spark, sf)
    return M.finalized(p, s, M.fuse_passes(p, s))


@query()
def segment_replays(spark, sf):
    lines = P.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).alias("m")))).alias("s"))
    o = P.read(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    s = o.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 2).alias("grp"), F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("start"), F.transform("s", lambda x: x["m"]).alias("v"))
    return M.replays(s).withColumn("cost", F.round("cost", 6))


@query()
def greedy_average_precision(spark, sf):
    boxes = P.boxes(spark, sf)
    found = Q.detection_average_precision(boxes, J.iou_pairs(boxes))
    return found.withColumn("average_precision", F.round("average_precision", 6))
