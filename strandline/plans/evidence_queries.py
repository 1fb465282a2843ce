"""Queries of caches, contracts, match records and bindings over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, lineage, matchdata, records
from ..sources import artifacts
from ..sources import proxies as P
from .registry import query


@query("""WITH c AS (SELECT l_suppkey AS k, l_partkey AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_partkey DESC) AS n FROM lineitem WHERE l_linenumber = 1)
  SELECT c_custkey AS k, coalesce(value, -1) AS cached, value IS NOT NULL AS hit FROM customer LEFT JOIN (SELECT * FROM c WHERE n = 1) ON k = c_custkey""")
def cache_hits(spark, sf):
    cache = P.read(spark, sf, "lineitem").where("l_linenumber = 1").selectExpr("l_suppkey AS k", "l_partkey AS value", "l_orderkey AS mtime")
    return joins.cache_split(P.read(spark, sf, "customer").selectExpr("c_custkey AS k"), cache, "k").select("k", F.coalesce("cached", F.lit(-1)).alias("cached"), "hit")


@query("""SELECT o_orderkey AS id, sha256('{"customer":' || o_custkey || ',"note":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"n' || o_custkey % 5 || '"' END || ',"version":2}') AS contract FROM orders""")
def contract_keys(spark, sf):
    o = P.read(spark, sf, "orders")
    key = artifacts.contract_key(version=F.lit(2), customer=F.col("o_custkey"), note=F.expr("if(o_custkey % 3 = 0, null, concat('n', o_custkey % 5))"))
    return o.select(F.col("o_orderkey").alias("id"), key.alias("contract"))


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS minute, l_returnflag AS type, l_suppkey AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS b, l_partkey % 25 AS t FROM lineitem), p AS (SELECT s_suppkey AS k, 'p' || s_suppkey AS id FROM supplier WHERE s_suppkey % 7 > 0)
  SELECT e.id, minute, type, coalesce(x.id, '') AS player, coalesce(y.id, '') AS secondary, coalesce(n_name, '') AS team FROM e LEFT JOIN p x ON x.k = a LEFT JOIN p y ON y.k = b LEFT JOIN nation ON n_nationkey = t AND n_nationkey <> 3""")
def canonical_timeline(spark, sf):
    events = P.read(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_quantity AS minute", "l_returnflag AS type", "l_suppkey AS player_id", "if(l_linenumber % 2 = 0, l_partkey, null) AS secondary_player_id", "l_partkey % 25 AS team_id", "'' AS detail")
    players = P.read(spark, sf, "supplier").where("s_suppkey % 7 > 0").selectExpr("s_suppkey AS provider_id", "concat('p', s_suppkey) AS id")
    teams = P.read(spark, sf, "nation").where("n_nationkey <> 3").selectExpr("n_nationkey AS provider_id", "n_name AS id")
    return matchdata.canonical_events(events, players, teams).select("id", "minute", "type", *(F.coalesce(c, F.lit("")).alias(c) for c in ("player", "secondary", "team")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, (CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END) IS DISTINCT FROM (CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END) AS conflict FROM lineitem""")
def roster_conflicts(spark, sf):
    bound = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 3)
    return P.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), lineage.roster_conflict(bound("l_partkey"), bound("l_suppkey")).alias("conflict"))


@query("""WITH a AS (SELECT l_suppkey AS person, l_orderkey * 10 + l_linenumber AS id, l_quantity AS start, l_quantity + l_partkey % 5 AS stop, CASE WHEN l_partkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS source, CASE l_orderkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'proposed' ELSE 'rejected' END AS status, round(1 - l_discount, 2) AS confidence FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY CASE WHEN source = 'manual' AND status = 'confirmed' THEN 4 WHEN source = 'manual' THEN 3 WHEN status = 'confirmed' THEN 2 ELSE 1 END DESC, confidence DESC, stop - start, start DESC, id) AS k FROM a WHERE status <> 'rejected' AND start <= 20 AND stop >= 20)
  SELECT person, id, start, stop, source, status, confidence FROM r WHERE k = 1""")
def active_actions(spark, sf):
    e = ("l_suppkey AS person", "l_orderkey * 10 + l_linenumber AS id", "l_quantity AS start", "l_quantity + l_partkey % 5 AS stop", "if(l_partkey % 4 = 0, 'manual', 'auto') AS source", "element_at(array('confirmed', 'proposed', 'rejected'), int(l_orderkey % 3 + 1)) AS status", "round(1 - l_discount, 2) AS confidence")
    return matchdata.active_action(P.read(spark, sf, "lineitem").selectExpr(*e), "person", F.lit(20.0))


@query("""WITH p AS (SELECT l_orderkey AS match_id, l_partkey % 200 AS id, l_linenumber % 2 AS team, l_suppkey % 9 AS number, CASE WHEN l_quantity > 10 THEN 'starter' ELSE 'bench' END AS part FROM lineitem),
  t AS (SELECT o_orderkey AS match_id, o_custkey % 200 AS a, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 200 END AS b, o_custkey % 150 AS out, o_orderkey % 90 AS inn FROM orders), k AS (SELECT DISTINCT match_id, id FROM p)
  SELECT match_id, 'duplicate-player' AS problem, id::VARCHAR AS detail FROM p GROUP BY match_id, id HAVING count(*) > 1 UNION SELECT match_id, 'duplicate-number', team || ':' || number FROM p GROUP BY match_id, team, number HAVING count(DISTINCT id) > 1
  UNION SELECT match_id, 'few-starters', team::VARCHAR FROM p GROUP BY match_id, team HAVING count(*) FILTER (part = 'starter') < 3
  UNION SELECT match_id, problem, id::VARCHAR FROM (SELECT match_id, 'unknown-player_id' AS problem, a AS id FROM t UNION ALL SELECT match_id, 'unknown-secondary_player_id', b FROM t UNION ALL SELECT match_id, 'unknown-player_out_id', out FROM t UNION ALL SELECT match_id, 'unknown-player_in_id', inn FROM t) u ANTI JOIN k USING (match_id, id) WHERE id IS NOT NULL""")
def manual_bundle_problems(spark, sf):
    players = P.read(spark, sf, "lineitem").selectExpr("l_orderkey AS match_id", "string(l_partkey % 200) AS id", "string(l_linenumber % 2) AS team_id", "l_suppkey % 9 AS number", "if(l_quantity > 10, 'starter', 'bench') AS lineup_role")
    timeline = P.read(spark, sf, "orders").selectExpr("o_orderkey AS match_id", "string(o_custkey % 200) AS player_id", "if(o_custkey % 4 > 0, string(o_orderkey % 200), null) AS secondary_player_id")
    changes = P.read(spark, sf, "orders").selectExpr("o_orderkey AS match_id", "string(o_custkey % 150) AS player_out_id", "string(o_orderkey % 90) AS player_in_id")
    return matchdata.bundle_problems(players, timeline, changes, least_starters=3)


@query("""WITH w AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS write_id, l_partkey % 4 AS expected FROM lineitem), c AS (SELECT s_suppkey AS k, s_suppkey % 4 AS revision FROM supplier WHERE s_suppkey % 5 > 0),
  o AS (SELECT w.*, row_number() OVER (PARTITION BY k ORDER BY write_id) AS n FROM w LEFT JOIN c USING (k) WHERE coalesce(revision, 0) = expected) SELECT k, write_id, expected + 1 AS revision FROM o WHERE n = 1""")
def accepted_writes(spark, sf):
    writes = P.read(spark, sf, "lineitem").selectExpr("l_suppkey AS k", "l_orderkey * 10 + l_linenumber AS write_id", "l_partkey % 4 AS expected")
    return records.compare_and_set(P.read(spark, sf, "supplier").where("s_suppkey % 5 > 0").selectExpr("s_suppkey AS k", "s_suppkey % 4 AS revision"), writes, "k")


@query(f"""WITH f AS (SELECT track_id, event_id AS frame, t, floor(t * 0.5::DOUBLE + 0.5)::BIGINT AS tick FROM {P.POINTS}), r AS (SELECT *, row_number() OVER (PARTITION BY track_id, tick ORDER BY abs(t - tick / 0.5::DOUBLE), t, frame) AS k FROM f)
  SELECT track_id, tick, frame, t FROM r WHERE k = 1""")
def frames_at_rate(spark, sf):
    frames = P.points(spark, sf).select("track_id", F.col("event_id").alias("frame"), "t")
    return artifacts.sampled_frames(frames, "track_id", 0.5)
