"""Queries of detector comparisons, association costs, event evidence and roll-ups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign, association, comparison, diagnostics, events, joins
from ..sources import proxies as P
from .registry import greedy_sql, query


#: Lines of an order as what two models saw on a frame.
_SEEN = """(SELECT l_orderkey AS frame, l_orderkey % 97 AS scene, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id, l_linenumber % 2 = 1 AS old, l_quantity * 2 AS x, l_discount * 100 AS y, 20.0::DOUBLE AS w,
  (15 + l_partkey % 80)::DOUBLE AS h, l_suppkey % 3 > 0 AS inside FROM lineitem)"""


def _seen(spark, sf):
    e = {"frame": "l_orderkey", "scene": "l_orderkey % 97", "id": "concat_ws('-', l_linenumber, l_partkey, l_suppkey)", "old": "l_linenumber % 2 = 1", "x": "l_quantity * 2", "y": "l_discount * 100", "w": "20D", "h": "double(15 + l_partkey % 80)", "inside": "l_suppkey % 3 > 0"}
    rows = P.read(spark, sf, "lineitem").select(*(F.expr(v).alias(k) for k, v in e.items()))
    return rows.where("old"), rows.where("not old")


_NEAR = f"""SELECT g.frame, g.id AS a, p.id AS b, round(sqrt((g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y)) / greatest(14.0::DOUBLE, least(g.h, p.h) * 0.72::DOUBLE), 9) AS ratio
  FROM (SELECT * FROM {_SEEN} WHERE old) g JOIN (SELECT * FROM {_SEEN} WHERE NOT old) p ON g.frame = p.frame WHERE ratio <= 1"""


@query(f"""WITH {greedy_sql(_NEAR, "ratio")},
  s AS (SELECT s.*, m.frame IS NOT NULL AS paired FROM {_SEEN} s LEFT JOIN m ON m.frame = s.frame AND s.id = CASE WHEN old THEN m.a ELSE m.b END)
  SELECT scene, count(*) FILTER (old AND paired) AS shared, count(*) FILTER (old AND NOT paired) AS baseline_only, count(*) FILTER (NOT old AND NOT paired) AS candidate_only, count(*) FILTER (old AND NOT paired AND inside) AS baseline_only_inside,
    count(*) FILTER (NOT old AND NOT paired AND inside) AS candidate_only_inside, count(*) FILTER (NOT old AND NOT paired AND inside) - count(*) FILTER (old AND NOT paired AND inside) AS inside_gain FROM s GROUP BY scene""")
def model_observation_counts(spark, sf):
    old, new = _seen(spark, sf)
    pairs = comparison.observation_pairs(old.withColumnRenamed("h", "height"), new.withColumnRenamed("h", "height")).withColumn("ratio", F.round("ratio", 9))
    return comparison.comparison_counts(old, new, assign.greedy_matches(pairs, "frame", "b_id", "c_id", "ratio", highest=False), "scene")


_OVER = f"""SELECT frame, a, b, round(i / (u - i), 9) AS iou FROM (SELECT g.frame, g.id AS a, p.id AS b, greatest(0, least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x)) * greatest(0, least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y)) AS i, g.w * g.h + p.w * p.h AS u
  FROM (SELECT * FROM {_SEEN} WHERE old) g JOIN (SELECT * FROM {_SEEN} WHERE NOT old) p ON g.frame = p.frame) WHERE i / (u - i) > 0.4"""


@query(f"""WITH {greedy_sql(_OVER, "iou DESC")}, f AS (SELECT frame FROM {_SEEN} GROUP BY frame HAVING bool_or(old) AND bool_or(NOT old)),
  s AS (SELECT s.*, m.frame IS NOT NULL AS paired, CASE WHEN h < 25 THEN '0-25px' WHEN h < 40 THEN '25-40px' WHEN h < 70 THEN '40-70px' ELSE '70-infpx' END AS size FROM {_SEEN} s SEMI JOIN f USING (frame) LEFT JOIN m ON m.frame = s.frame AND s.id = CASE WHEN old THEN m.a ELSE m.b END)
  SELECT coalesce(size, 'all') AS stratum, count(DISTINCT frame) AS frames, count(*) FILTER (old) AS baseline, count(*) FILTER (old AND paired) AS baseline_matched, count(*) FILTER (NOT old) AS challenger, count(*) FILTER (NOT old AND NOT paired) AS challenger_only,
    round(count(*) FILTER (old AND paired)::DOUBLE / nullif(count(*) FILTER (old), 0), 3) AS matched_ratio FROM s GROUP BY ROLLUP (size)""")
def detector_shadow_strata(spark, sf):
    old, new = _seen(spark, sf)
    boxes = old.withColumn("side", F.lit("gt")).unionByName(new.withColumn("side", F.lit("pred"))).withColumn("score", F.lit(1.0))
    pairs = joins.iou_pairs(boxes, 0.4).select("frame", F.col("g_id").alias("b_id"), F.col("p_id").alias("c_id"), F.round("iou", 9).alias("iou"))
    return comparison.shadow_strata(old, new, assign.greedy_matches(pairs, "frame", "b_id", "c_id", "iou"))


#: Components of an embedding that the contract asks for.
DIMENSION = 64
#: Crops with an embedding, sound or broken, and a role.
_CROPS = f"""(SELECT id, id % 11 <> 4 AS usable, CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN v[1:10] WHEN 2 THEN list_transform(v, lambda x: x * 0) WHEN 3 THEN list_transform(v, lambda x: x * 2) WHEN 5 THEN list_transform(v, lambda x: 'inf'::DOUBLE) ELSE v END AS e,
  'r' || person % 4 AS role, 'r' || (person + (id % 5 = 0)::INT) % 5 AS predicted, {DIMENSION} AS d FROM {P.VECTORS})"""
_ROLES = ["r0", "r1", "r2", "r3"]
_FAULT = f"""(SELECT *, len(list_filter(e, lambda x: isfinite(x))) = len(e) AS finite, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size,
  CASE WHEN NOT usable THEN 'worker-marked-unusable' WHEN e IS NULL OR len(e) <> d THEN 'embedding-dimension-invalid' WHEN NOT finite THEN 'embedding-non-finite' WHEN size <= 1e-12 THEN 'embedding-zero' WHEN abs(size - 1) > 0.01 THEN 'embedding-not-normalized' END AS problem FROM {_CROPS})"""


def _crops(spark, sf):
    rows = P.vectors(spark, sf)
    e = F.expr("CASE id % 11 WHEN 0 THEN null WHEN 1 THEN slice(v, 1, 10) WHEN 2 THEN transform(v, x -> x * 0) WHEN 3 THEN transform(v, x -> x * 2) WHEN 5 THEN transform(v, x -> double('inf')) ELSE v END")
    crops = rows.select("id", (F.col("id") % 11 != 4).alias("usable"), e.alias("embedding"), F.expr("concat('r', person % 4)").alias("role"), F.expr("concat('r', (person + int(id % 5 = 0)) % 5)").alias("predicted"))
    return crops


@query(f"SELECT id, coalesce(problem, '') AS problem, round(CASE WHEN usable AND len(e) = d AND finite THEN abs(size - 1) END, 9) AS norm_error FROM {_FAULT}")
def embedding_contract(spark, sf):
    return comparison.embedding_problems(_crops(spark, sf), DIMENSION).select("id", F.coalesce("problem", F.lit("")).alias("problem"), F.round("norm_error", 9).alias("norm_error"))


@query(f"SELECT role AS expected, CASE WHEN usable AND predicted <> 'r4' THEN predicted ELSE '__abstain__' END AS predicted, count(*) AS n FROM {_CROPS} GROUP BY ALL")
def identity_role_confusion(spark, sf):
    return comparison.role_confusion(_crops(spark, sf), _ROLES)


@query(f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (problem IS NULL) AS valid, max(CASE WHEN usable AND len(e) = d AND finite THEN abs(size - 1) END) AS worst, count(*) FILTER (usable AND predicted = role) AS correct FROM {_FAULT})
  SELECT total, valid, round(valid / total, 9) AS usable_ratio, round(worst, 9) AS worst_norm_error, round(correct / total, 9) AS role_accuracy, valid = total AS contract_passes, valid / total >= 0.5 AS usable_passes, correct / total >= 0.7 AS roles_pass FROM s""")
def identity_contract_checks(spark, sf):
    return comparison.identity_contract(_crops(spark, sf), _ROLES, DIMENSION, 0.5, 0.7).withColumns({c: F.round(c, 9) for c in ("usable_ratio", "worst_norm_error", "role_accuracy")})


_EDGES = """(SELECT l_suppkey % 50 AS scene, CASE l_partkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'rejected' END AS verdict, CASE WHEN l_linenumber % 2 = 0 THEN 'manual' ELSE 'automatic' END AS source, CASE WHEN l_partkey % 19 > 0 THEN round((l_partkey % 101) / 100, 2) END AS score,
  [CASE WHEN l_suppkey % 2 = 0 THEN 'strong-reid' ELSE 'gap' END, CASE WHEN l_linenumber % 3 = 0 THEN 'ambiguous-next' ELSE 'time' END] AS reasons, least(l_linenumber, l_orderkey % 5) AS strong FROM lineitem)"""


@query(f"""WITH t AS (SELECT o_custkey % 50 AS scene, count(*) AS tracklets, count(*) FILTER (o_orderkey % 13 > 0) AS eligible, sum(o_orderkey % 40)::BIGINT AS observations, bool_and(o_orderkey % 290 > 0) AS all_preserved, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS digest FROM orders GROUP BY 1),
  i AS (SELECT c_custkey % 50 AS scene, count(*) AS identities, count(*) FILTER (c_custkey % 3 = 0) AS resolved, count(*) FILTER (c_custkey % 3 = 1) AS provisional, count(*) FILTER (c_custkey % 3 = 2) AS excluded, count(*) FILTER (c_custkey % 17 = 0) AS conflicts FROM customer GROUP BY 1),
  e AS (SELECT scene, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict = 'accepted' AND source = 'automatic') AS automatic, count(*) FILTER (verdict = 'accepted' AND source = 'manual') AS manual,
    count(*) FILTER (verdict = 'review' AND reasons[2] = 'ambiguous-next') AS ambiguous, count(*) FILTER (verdict = 'accepted' AND reasons[1] = 'strong-reid' AND strong >= 2) AS strong_both_ways, round(quantile_cont(score, 0.1) FILTER (verdict <> 'rejected'), 6) AS score_p10, round(quantile_cont(score, 0.5) FILTER (verdict <> 'rejected'), 6) AS score_p50,
    round(quantile_cont(score, 0.1) FILTER (verdict = 'accepted'), 6) AS accepted_p10, round(quantile_cont(score, 0.5) FILTER (verdict = 'review'), 6) AS review_p50 FROM {_EDGES} GROUP BY 1),
  r AS (SELECT scene, string_agg(reason || ':' || n, ',' ORDER BY reason) AS rejections FROM (SELECT scene, reason, count(*) AS n FROM (SELECT scene, unnest(reasons) AS reason FROM {_EDGES} WHERE verdict = 'rejected') GROUP BY ALL) GROUP BY scene)
  SELECT scene, tracklets, eligible, observations, all_preserved, digest, coalesce(identities, 0) AS identities, coalesce(resolved, 0) AS resolved, coalesce(provisional, 0) AS provisional, coalesce(excluded, 0) AS excluded, coalesce(conflicts, 0) AS conflicts, coalesce(accepted, 0) AS accepted, coalesce(review, 0) AS review,
    coalesce(rejected, 0) AS rejected, coalesce(automatic, 0) AS automatic, coalesce(manual, 0) AS manual, coalesce(ambiguous, 0) AS ambiguous, coalesce(strong_both_ways, 0) AS strong_both_ways, score_p10, score_p50, accepted_p10, review_p50, coalesce(rejections, '') AS rejections FROM t LEFT JOIN i USING (scene) LEFT JOIN e USING (scene) LEFT JOIN r USING (scene)""")
def resolver_diagnostics(spark, sf):
    tracklets = P.read(spark, sf, "orders").selectExpr("o_custkey % 50 AS scene", "o_orderkey AS id", "o_orderkey % 13 = 0 AS excluded", "o_orderkey % 40 AS observations", "if(o_orderkey % 290 > 0, o_orderkey % 7, null) AS identity")
    identities = P.read(spark, sf, "customer").selectExpr("c_custkey % 50 AS scene", "element_at(array('resolved', 'provisional', 'excluded'), int(c_custkey % 3 + 1)) AS status", "c_custkey % 17 = 0 AS conflict")
    edges = P.read(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 50 AS scene", "element_at(array('accepted', 'review', 'rejected'), int(l_partkey % 3 + 1)) AS verdict", "if(l_linenumber % 2 = 0, 'manual', 'automatic') AS source", "if(l_partkey % 19 > 0, round((l_partkey % 101) / 100, 2), null) AS score",
        "array(if(l_suppkey % 2 = 0, 'strong-reid', 'gap'), if(l_linenumber % 3 = 0, 'ambiguous-next', 'time')) AS reasons", "l_linenumber AS strong_left", "l_orderkey % 5 AS strong_right",
    )
    listed = F.array_join(F.transform(F.map_entries("rejections"), lambda r: F.concat_ws(":", r["key"], r["value"].cast("string"))), ",")
    return diagnostics.resolver_diagnostics(tracklets, identities, edges).withColumn("rejections", F.coalesce(listed, F.lit("")))


@query("""SELECT l_orderkey % 500 AS scene, sum(l_quantity::BIGINT)::BIGINT AS raw, sum(l_quantity::BIGINT - l_linenumber)::BIGINT AS retained, sum(l_linenumber)::BIGINT AS discarded, sum(l_partkey % 9)::BIGINT AS speed_samples, sum(l_partkey % 4)::BIGINT AS violations, sum(l_partkey % 5)::BIGINT AS raw_violations,
    sum(l_suppkey % 20)::BIGINT AS images, sum(l_suppkey % 15)::BIGINT AS published, sum(l_suppkey % 11)::BIGINT AS accepted, sum(l_suppkey % 3)::BIGINT AS rejected, sum(l_suppkey % 2)::BIGINT AS unprojected, count(*) FILTER (l_linenumber > 1) AS split_tracks, sum(CASE WHEN l_linenumber > 1 THEN l_partkey % 6 ELSE 0 END)::BIGINT AS discarded_fragments,
    round(max(CASE WHEN l_partkey % 10 > 0 THEN l_quantity / 7 END), 3) AS raw_speed, round(max(CASE WHEN l_partkey % 3 > 0 THEN l_quantity / 8 END), 3) AS adjusted_speed, round(sum(l_suppkey % 15)::DOUBLE / greatest(1, sum(l_suppkey % 20)), 3) AS coverage, round(sum(l_suppkey % 11)::DOUBLE / greatest(1, sum(l_suppkey % 15)), 3) AS metric_coverage
  FROM lineitem GROUP BY 1""")
def projection_diagnostics(spark, sf):
    e = {
        "scene": "l_orderkey % 500", "raw": "bigint(l_quantity)", "retained": "bigint(l_quantity) - l_linenumber", "discarded": "l_linenumber", "speed_samples": "l_partkey % 9", "violations": "l_partkey % 4", "raw_violations": "l_partkey % 5", "fragments": "l_linenumber", "discarded_fragments": "l_partkey % 6", "raw_speed": "if(l_partkey % 10 > 0, l_quantity / 7, null)",
        "adjusted_speed": "if(l_partkey % 3 > 0, l_quantity / 8, null)", "images": "l_suppkey % 20", "published": "l_suppkey % 15", "accepted": "l_suppkey % 11", "rejected": "l_suppkey % 3", "unprojected": "l_suppkey % 2",
    }
    return diagnostics.projection_diagnostics(P.read(spark, sf, "lineitem").select(*(F.expr(v).alias(k) for k, v in e.items())))


@query("""WITH a AS (SELECT l_suppkey AS person, l_linenumber % 2 AS source, l_orderkey AS event, l_linenumber % 3 AS kind, CASE WHEN l_partkey % 10 > 0 THEN l_quantity END AS t, 1 - l_discount AS confidence, l_suppkey % 20 AS s, l_suppkey % 20 + 25 AS e FROM lineitem),
  b AS (SELECT o_custkey AS player, o_orderkey % 2 AS source, o_orderkey AS event, o_orderkey % 3 AS kind, (o_orderkey % 50)::DOUBLE AS t, o_custkey % 30 AS s, o_custkey % 30 + 15 AS e FROM orders),
  j AS (SELECT person, player, least(confidence, 0.95::DOUBLE) AS confidence, CASE WHEN a.kind <> b.kind THEN 'event-kind-mismatch' WHEN a.t IS NULL THEN 'event-time-unavailable' WHEN abs(a.t - b.t) > 3 THEN 'event-time-mismatch' WHEN a.t < a.s - 3 OR a.t > a.e + 3 THEN 'event-outside-canonical-visible-interval'
    WHEN b.t < b.s - 2 OR b.t > b.e + 2 THEN 'event-outside-player-active-interval' END AS state FROM a JOIN b USING (source, event))
  SELECT person, player, round(coalesce(max(confidence) FILTER (state IS NULL), -1), 9) AS event_conf, coalesce(string_agg(DISTINCT state, ',' ORDER BY state) FILTER (state IN ('event-kind-mismatch', 'event-time-mismatch', 'event-outside-player-active-interval')), '') AS event_conflicts,
    coalesce(string_agg(DISTINCT state, ',' ORDER BY state) FILTER (state IN ('event-time-unavailable', 'event-outside-canonical-visible-interval')), '') AS event_reasons FROM j GROUP BY ALL""")
def roster_event_evidence(spark, sf):
    people = P.read(spark, sf, "lineitem").selectExpr("l_suppkey AS person", "l_linenumber % 2 AS source", "l_orderkey AS event", "l_linenumber % 3 AS kind", "if(l_partkey % 10 > 0, l_quantity, null) AS t", "1 - l_discount AS confidence", "array(named_struct('s', double(l_suppkey % 20), 'e', double(l_suppkey % 20 + 25))) AS intervals")
    players = P.read(spark, sf, "orders").selectExpr("o_custkey AS player", "o_orderkey % 2 AS source", "o_orderkey AS event", "o_orderkey % 3 AS kind", "double(o_orderkey % 50) AS t", "0.95D AS confidence", "array(named_struct('s', double(o_custkey % 30), 'e', double(o_custkey % 30 + 15))) AS intervals")
    found = events.event_evidence(people, players)
    return found.select("person", "player", F.round(F.coalesce("event_conf", F.lit(-1.0)), 9).alias("event_conf"), *(F.array_join(c, ",").alias(c) for c in ("event_conflicts", "event_reasons")))


@query("""WITH s AS (SELECT o_orderkey AS scene, CASE WHEN o_orderkey % 11 = 0 THEN 'A Smoke TEST run' ELSE o_orderstatus END AS title, o_orderkey % 7 = 0 AS none, CASE WHEN o_custkey % 9 = 0 THEN 'Smoke.mp4' ELSE 'match.mp4' END AS filename, o_custkey % 4 = 0 AS multi, CASE WHEN o_custkey % 5 = 0 THEN 'p' ELSE '' END AS parent, CASE WHEN o_custkey % 6 = 0 THEN 's' END AS segment FROM orders)
  SELECT scene, CASE WHEN none OR lower(title) LIKE '%smoke test%' OR lower(filename) LIKE '%smoke%' THEN 'demo' WHEN multi THEN 'multi-pass' WHEN parent <> '' OR coalesce(segment, '') <> '' THEN 'segment' ELSE 'video' END AS kind, 'label:' || filename || CASE WHEN multi THEN ',total:' || scene ELSE '' END AS progress FROM s""")
def scene_kinds(spark, sf):
    s = P.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS scene", "if(o_orderkey % 11 = 0, 'A Smoke TEST run', o_orderstatus) AS title",
        "if(o_orderkey % 7 = 0, null, named_struct('filename', if(o_custkey % 9 = 0, 'Smoke.mp4', 'match.mp4'), 'multi_pass', o_custkey % 4 = 0, 'parent', if(o_custkey % 5 = 0, 'p', ''), 'segment', if(o_custkey % 6 = 0, 's', null))) AS video",
        "map(if(o_custkey % 4 = 0, 'total', 'owner'), string(o_orderkey), 'label', if(o_custkey % 9 = 0, 'Smoke.mp4', 'match.mp4'), 'secret', 'x') AS progress",
    )
    shown = F.array_sort(F.transform(F.map_entries(diagnostics.compact_progress(F.col("progress"))), lambda r: F.concat_ws(":", r["key"], r["value"])))
    return s.select("scene", diagnostics.scene_kind(F.col("title"), F.col("video")).alias("kind"), F.array_join(shown, ",").alias("progress"))


_PAIRS = {
    "id": "l_orderkey * 10 + l_linenumber", "dt": "(l_linenumber - 1) * 0.12D", "image": "l_quantity * 3", "height": "20D + l_partkey % 60", "last_height": "20D + l_suppkey % 60", "appearance": "(l_partkey % 30) / 20D", "reid": "CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 90) / 100D END", "reid_support": "l_suppkey % 4",
    "pitch": "CASE WHEN l_suppkey % 3 > 0 THEN l_quantity / 5 END", "uncertainty": "CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 7) * 1D END", "marked": "l_partkey % 13 = 0", "fallback": "l_partkey % 7 > 0", "a_team": "CASE WHEN l_partkey % 3 = 0 THEN 'x' END", "b_team": "CASE WHEN l_suppkey % 6 = 0 THEN 'y' WHEN l_suppkey % 6 = 1 THEN 'x' END",
    "a_binding": "CASE WHEN l_partkey % 11 = 0 THEN 'bound' END", "b_binding": "CASE WHEN l_suppkey % 4 = 0 THEN 'bound' END", "a_player": "CASE WHEN l_partkey % 5 < 2 THEN 'p' || l_partkey % 2 END", "b_player": "CASE WHEN l_suppkey % 5 < 2 THEN 'p' || l_suppkey % 2 END",
}
_PAIRS_SQL = ", ".join(f"{v} AS {k}" for k, v in _PAIRS.items()).replace("0.12D", "0.12::DOUBLE").replace("20D", "20::DOUBLE").replace("100D", "100::DOUBLE").replace("1D", "1::DOUBLE")


@query(f"""WITH p AS (SELECT {_PAIRS_SQL}, l_linenumber % 4 AS ao, l_partkey % 4 AS bo FROM lineitem), g AS (SELECT *, greatest(48, 2.4::DOUBLE * height, 2.4::DOUBLE * last_height) * (1 + least(2.2::DOUBLE, greatest(0, dt / 0.1::DOUBLE - 1) * 0.45::DOUBLE)) AS gate, 2.2::DOUBLE + 16 * dt + least(5, coalesce(uncertainty, 0)) AS reach FROM p),
  r AS (SELECT *, CASE WHEN dt <= 0 THEN 'non-positive-time-gap' WHEN dt > 0.65 THEN 'time-gap-too-large' WHEN a_team <> b_team THEN 'manual-team-conflict' WHEN ao > 0 AND bo > 0 AND ao <> bo THEN 'manual-identity-conflict' WHEN a_binding IS NOT NULL AND b_binding IS NOT NULL AND a_player IS DISTINCT FROM b_player THEN 'roster-binding-conflict'
    WHEN (a_binding IS NULL) = (b_binding IS NULL) AND a_player <> b_player THEN 'external-player-conflict' WHEN pitch IS NULL AND NOT fallback THEN 'metric-position-unavailable' WHEN pitch IS NULL AND image > gate THEN 'image-fallback-pixel-gate' WHEN reid > 0.72 AND reid_support >= 2 THEN 'reid-distance-gate' WHEN pitch > reach THEN 'metric-distance-gate' END AS reason,
    least(2, image / greatest(1, gate)) AS i, least(2, appearance / 0.9::DOUBLE) AS l, least(2, reid / 0.38::DOUBLE) AS e, pitch / greatest(0.5::DOUBLE, reach) AS m, least(1, abs(ln(greatest(height, last_height) / greatest(1, least(height, last_height)))) / 0.7::DOUBLE) AS s FROM g)
  SELECT id, coalesce(reason, '') AS reason, round(CASE WHEN reason IS NULL THEN CASE WHEN pitch IS NULL AND reid IS NULL THEN 0.58 * i + 0.34 * l + 0.08 * s WHEN pitch IS NULL THEN 0.51 * i + 0.18 * l + 0.25 * e + 0.06 * s WHEN reid IS NULL THEN 0.10 * i + 0.18 * l + 0.62 * m + 0.10 * s ELSE 0.08 * i + 0.08 * l + 0.22 * e + 0.57 * m + 0.05 * s END
    * CASE WHEN marked THEN 0.2 WHEN a_player = b_player THEN 0.35 ELSE 1 END END, 6) AS cost FROM r""")
def association_costs(spark, sf):
    owners = lambda c: F.when(c > 0, F.array(c.cast("string"))).otherwise(F.array().cast("array<string>"))
    pairs = P.read(spark, sf, "lineitem").select(*(F.expr(v).alias(k) for k, v in _PAIRS.items()), owners(F.col("l_linenumber") % 4).alias("a_owners"), owners(F.col("l_partkey") % 4).alias("b_owners"))
    return association.association_costs(pairs).select("id", F.coalesce("reason", F.lit("")).alias("reason"), F.round("cost", 6).alias("cost"))
