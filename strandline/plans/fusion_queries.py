"""Queries of the evidence-fusion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuse as U
from ..sources import proxies as P
from .registry import query


@query(f"SELECT id, hash, quality, copies FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY quality DESC, id) AS k, count(*) OVER (PARTITION BY hash) AS copies FROM {P.CONTENT}) WHERE k = 1")
def dedup_fingerprint_best(spark, sf):
    return U.best_per_fingerprint(P.content(spark, sf))


@query(f"SELECT id, hash, quality FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM {P.CONTENT}) WHERE n = 1")
def reject_all_duplicates(spark, sf):
    return U.reject_all_duplicates(P.content(spark, sf), "hash").select("id", "hash", "quality")


_CAPPED = f"""(SELECT *, row_number() OVER (PARTITION BY tracklet ORDER BY conf DESC, t, id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tracklet, bin ORDER BY conf DESC, t, id) AS r FROM (SELECT *, floor(t / 30)::BIGINT AS bin FROM {P.READINGS})) WHERE r = 1)"""


@query(f"SELECT tracklet, bin, id, number, conf, rank FROM {_CAPPED} WHERE rank <= 16")
def window_top1_then_cap(spark, sf):
    return U.window_best_then_cap(P.readings(spark, sf), 30.0, 16).select("tracklet", "bin", "id", "number", "conf", "rank")


@query(f"""WITH s AS (SELECT tracklet, number, sum(conf) AS weight, count(*) AS support, avg(conf) AS mean FROM {P.READINGS} GROUP BY ALL),
  h AS (SELECT *, weight / sum(weight) OVER (PARTITION BY tracklet) AS share, row_number() OVER (PARTITION BY tracklet ORDER BY round(weight, 6) DESC, number) AS rank FROM s),
  n AS (SELECT *, coalesce(lead(share) OVER (PARTITION BY tracklet ORDER BY rank), 0.0) AS runner FROM h)
  SELECT tracklet, number, support, round(share, 6) AS share, round(share - runner, 6) AS margin, CASE WHEN runner >= 0.34 OR share - runner < 0.20 THEN 'conflict' WHEN support >= 2 AND least(1.0, 0.6 * mean + 0.4 * share) >= 0.80 THEN 'reliable' ELSE 'provisional' END AS state FROM n WHERE rank = 1""")
def vote_share_margin(spark, sf):
    return U.votes(P.readings(spark, sf)).withColumns({"share": F.round("share", 6), "margin": F.round("margin", 6)})


@query(f"""WITH c AS (SELECT * FROM {_CAPPED} WHERE rank <= 16), t AS (SELECT tracklet % 10 AS owner, tracklet, number, sum(conf) AS weight, count(*) AS n FROM c GROUP BY ALL),
  o AS (SELECT owner, number, sum(weight) AS weight, sum(n)::BIGINT AS n, count(DISTINCT tracklet) AS tracklets FROM t GROUP BY ALL)
  SELECT owner, number, round(weight, 6) AS weight, n, tracklets FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(weight, 6) DESC, number) AS k FROM o) WHERE k = 1""")
def two_level_fusion(spark, sf):
    return U.fused_votes(P.readings(spark, sf), F.col("tracklet") % 10, 30.0, 16).withColumn("weight", F.round("weight", 6))


@query(f"SELECT track_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counts FROM (SELECT track_id, kind, count(*) AS n FROM {P.POINTS} GROUP BY ALL) GROUP BY track_id")
def counter_map(spark, sf):
    m = U.counter_maps(P.points(spark, sf), "track_id", "kind")
    return m.select("track_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query(f"""WITH RECURSIVE r AS (SELECT track_id, event_id, t, row_number() OVER (PARTITION BY track_id ORDER BY conf DESC, event_id) AS k FROM {P.POINTS}),
  f AS (SELECT track_id, 1 AS k, [t] AS kept, 1 AS pick, event_id, t, true AS took FROM r WHERE k = 1
    UNION ALL SELECT f.track_id, r.k, CASE WHEN ok THEN list_append(f.kept, r.t) ELSE f.kept END, CASE WHEN ok THEN f.pick + 1 ELSE f.pick END, r.event_id, r.t, ok
    FROM f JOIN r ON r.track_id = f.track_id AND r.k = f.k + 1, LATERAL (SELECT len(f.kept) < 12 AND len(list_filter(f.kept, lambda x: abs(x - r.t) < 24)) = 0 AS ok))
  SELECT track_id, pick, event_id, round(t, 6) AS t FROM f WHERE took""")
def separated_topk(spark, sf):
    return U.separated_top(P.points(spark, sf), "track_id", 24.0, 12).withColumn("t", F.round("t", 6))


_FORCED = "l_returnflag = 'R' AND l_discount = 0.10"


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS f FROM lineitem) WHERE f <= 5 OR ({_FORCED})""")
def topk_forced(spark, sf):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    forced = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.10)
    return U.top_with_forced(P.read(spark, sf, "lineitem"), "l_suppkey", order, forced, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query(f"""SELECT track_id, bin, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY conf DESC, event_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id, bin ORDER BY conf DESC, event_id) AS r FROM (SELECT *, floor(t / 6)::BIGINT AS bin FROM {P.POINTS})) WHERE r = 1) WHERE rank <= 64""")
def binned_reservoir(spark, sf):
    return U.binned_reservoir(P.points(spark, sf), "track_id", 6.0, 64).select("track_id", "bin", "event_id", "rank")
