"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import blocks as B
from ..operators import graph as G
from ..operators import joins as J
from ..sources import proxies as P
from .registry import greedy_sql, query

#: "Now" of the queue queries, in epoch days, and the states that count as active.
NOW, ACTIVE, PROCESSING = 10_300.0, ["P", "O"], "P"


@query(f"""SELECT j.id, status, available, requested, job_id IS NOT NULL AS had_lease FROM {P.JOBS} j LEFT JOIN {P.LEASES} l ON j.id = l.job_id
  WHERE status IN ('P', 'O') AND (status = 'P' OR available <= {NOW}) AND (expires IS NULL OR expires <= {NOW})""")
def runnable_jobs(spark, sf):
    return J.runnable_jobs(P.jobs(spark, sf), P.leases(spark, sf), ACTIVE, PROCESSING, NOW)


@query(f"SELECT j.id, status, expires FROM {P.JOBS} j JOIN {P.LEASES} l ON j.id = l.job_id WHERE expires > {NOW}")
def live_claims(spark, sf):
    return J.live_claims(P.jobs(spark, sf), P.leases(spark, sf), NOW)


@query(f"SELECT id, status FROM {P.JOBS} WHERE id NOT IN (SELECT job_id FROM {P.LEASES})")
def orphan_references(spark, sf):
    return J.unknown_references(P.jobs(spark, sf), "id", P.leases(spark, sf), "job_id").select("id", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def referenced_only(spark, sf):
    return P.read(spark, sf, "customer").join(P.read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"""SELECT frame, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred FROM (SELECT frame, count(*) AS n_gt FROM {P.BOXES} WHERE side = 'gt' GROUP BY 1)
  FULL JOIN (SELECT frame, count(*) AS n_pred FROM {P.BOXES} WHERE side = 'pred' GROUP BY 1) USING (frame)""")
def frame_full_outer(spark, sf):
    return J.frame_outer(P.boxes(spark, sf))


@query(f"SELECT a.owner, a.id AS id_a, b.id AS id_b, b.s - a.e AS gap FROM {P.INTERVALS} a JOIN {P.INTERVALS} b ON a.owner = b.owner AND a.id <> b.id AND b.s - a.e BETWEEN 0 AND 20")
def pairs_time_gated(spark, sf):
    return J.time_gated_pairs(P.intervals(spark, sf), 20.0)


_CLICK = f"(SELECT event_id AS id, track_id AS who, t FROM {P.POINTS} WHERE kind = 'click')"
_VIEW = f"(SELECT event_id AS id, track_id AS who, t FROM {P.POINTS} WHERE kind = 'view')"


def _kind(spark, sf, kind):
    return P.points(spark, sf).where(F.col("kind") == kind).select(F.col("event_id").alias("id"), F.col("track_id").alias("who"), "t")


@query(f"""SELECT c.id, c.who, m.rid AS match_id, round(m.d, 6) AS distance FROM {_CLICK} c LEFT JOIN (
  SELECT c.id, v.id AS rid, abs(c.t - v.t) AS d, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.t - v.t), v.t, v.id) AS k FROM {_CLICK} c JOIN {_VIEW} v ON c.who = v.who AND abs(c.t - v.t) <= 5) m ON c.id = m.id AND k = 1""")
def asof_nearest_tolerance(spark, sf):
    return J.asof_nearest(_kind(spark, sf, "click"), _kind(spark, sf, "view"), "who", 5.0).select("id", "who", "match_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT id, side, rank, anchor_id FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY d, anchor_id) AS rank FROM (
  SELECT c.id, v.id AS anchor_id, abs(c.t - v.t) AS d, CASE WHEN v.t < c.t THEN 'before' ELSE 'after' END AS side FROM {_CLICK} c JOIN {_VIEW} v ON c.who = v.who AND abs(c.t - v.t) <= 48 AND v.t <> c.t)) WHERE rank <= 2""")
def bracketing_anchors(spark, sf):
    return J.bracketing(_kind(spark, sf, "click"), _kind(spark, sf, "view"), "who", 48.0)


@query(f"SELECT a.owner, a.id AS id_a, b.id AS id_b, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM {P.INTERVALS} a JOIN {P.INTERVALS} b ON a.owner = b.owner AND a.id < b.id AND greatest(a.s, b.s) < least(a.e, b.e)")
def interval_overlap(spark, sf):
    return J.interval_pairs(P.intervals(spark, sf))


_UNION = f"""(SELECT owner, part, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS part FROM (
  SELECT *, CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END AS new FROM (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {P.INTERVALS}))) GROUP BY owner, part)"""


@query(f"SELECT owner, part::BIGINT AS part, s, e, n FROM {_UNION}")
def interval_union(spark, sf):
    return J.interval_union(P.intervals(spark, sf))


@query(f"SELECT owner, covered, span, round(covered / span, 6) AS coverage FROM (SELECT owner, sum(e - s) AS covered, max(e) - min(s) AS span FROM {_UNION} GROUP BY 1)")
def interval_coverage(spark, sf):
    return J.interval_coverage(P.intervals(spark, sf)).select("owner", "covered", "span", F.round("coverage", 6).alias("coverage"))


@query(f"""SELECT c.id, count(i.id) AS n, min_by(i.id, struct_pack(s := i.s, i := i.id)) AS first_id FROM (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS owner, min(l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) c LEFT JOIN {P.INTERVALS} i ON c.owner = i.owner AND i.s <= c.t AND c.t < i.e GROUP BY c.id""")
def point_in_interval(spark, sf):
    line = P.read(spark, sf, "lineitem").join(P.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = line.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("owner")).agg(F.min(F.unix_date(F.col("l_shipdate").cast("date"))).cast("double").alias("t"))
    return J.points_in_intervals(asked, P.intervals(spark, sf))


@query(f"SELECT owner, count(*) AS pairs, sum(overlap) AS days FROM (SELECT a.owner, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM {P.INTERVALS} a JOIN {P.INTERVALS} b ON a.owner = b.owner AND a.id < b.id AND greatest(a.s, b.s) < least(a.e, b.e)) GROUP BY owner")
def simultaneous_duplicates(spark, sf):
    return J.interval_pairs(P.intervals(spark, sf)).groupBy("owner").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("days"))


@query(f"SELECT event_id, (t >= 100)::INT + (t >= 300)::INT + (t >= 500)::INT AS bucket FROM {P.POINTS}")
def breakpoint_bucket(spark, sf):
    return P.points(spark, sf).select("event_id", J.breakpoint_bucket(F.col("t"), [100.0, 300.0, 500.0]).alias("bucket"))


_IOU = f"""(SELECT frame, g_id, p_id, score, inter / (1600.0::DOUBLE - inter) AS iou FROM (SELECT g.frame, g.id AS g_id, p.id AS p_id, p.score,
  greatest(0.0, least(g.x + 20, p.x + 20) - greatest(g.x, p.x)) * greatest(0.0, least(g.y + 40, p.y + 40) - greatest(g.y, p.y)) AS inter
  FROM {P.BOXES} g JOIN {P.BOXES} p ON g.frame = p.frame AND g.side = 'gt' AND p.side = 'pred') WHERE inter > 0)"""


@query(f"SELECT frame, g_id, p_id, round(iou, 6) AS iou FROM {_IOU}")
def iou_pairs(spark, sf):
    return J.iou_pairs(P.boxes(spark, sf)).select("frame", "g_id", "p_id", F.round("iou", 6).alias("iou"))


def _candidates(spark, sf):
    return J.iou_pairs(P.boxes(spark, sf), 0.5).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {greedy_sql(f"SELECT frame, g_id AS a, p_id AS b, round(iou, 9) AS iou FROM {_IOU} WHERE iou > 0.5", "iou DESC")} SELECT m.frame, m.a AS g_id, m.b AS p_id, pr.iou FROM m JOIN pr USING (frame, a, b)""")
def iou_greedy_match(spark, sf):
    return A.greedy_matches(_candidates(spark, sf), "frame", "g_id", "p_id", "iou")


@query()
def iou_optimal_match_counts(spark, sf):
    out = A.optimal_matches(_candidates(spark, sf), "frame", "g_id", "p_id", "iou")
    return out.groupBy("frame").agg(F.count("*").alias("matches"), F.round(F.sum("iou"), 6).alias("iou"))


@query(f"""WITH c AS (SELECT frame, g_id, p_id, round(iou, 9) AS iou FROM {_IOU} WHERE iou > 0.5),
  r AS (SELECT *, row_number() OVER (PARTITION BY frame, g_id ORDER BY iou DESC, g_id, p_id) AS a, row_number() OVER (PARTITION BY frame, p_id ORDER BY iou DESC, g_id, p_id) AS b FROM c)
  SELECT frame, g_id, p_id, round(iou, 6) AS iou FROM r WHERE a = 1 AND b = 1""")
def iou_mutual_best(spark, sf):
    return A.mutual_best(_candidates(spark, sf), "frame", "g_id", "p_id", "iou").select("frame", "g_id", "p_id", F.round("iou", 6).alias("iou"))


@query()
def box_suppression(spark, sf):
    return A.suppress(P.boxes(spark, sf), "frame", 0.5).select("frame", "id", "score")


@query()
def roster_assignment_abstain(spark, sf):
    edges = J.iou_pairs(P.boxes(spark, sf), 0.2).withColumn("iou", F.round("iou", 9))
    return A.assign_or_abstain(edges, "frame", "g_id", "p_id", "iou", 0.47, 0.05)


@query(f"""SELECT who, a.id AS a_id, b.id AS b_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)), 6) AS distance FROM
  (SELECT event_id AS id, track_id AS who, x, z FROM {P.POINTS} WHERE kind = 'click') a JOIN (SELECT event_id AS id, track_id AS who, x, z FROM {P.POINTS} WHERE kind = 'view') b USING (who)
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= 3""")
def distance_gated_pairs(spark, sf):
    p = P.points(spark, sf).select(F.col("event_id").alias("id"), F.col("track_id").alias("who"), "x", "z", "kind")
    return J.distance_pairs(p.where("kind = 'click'"), p.where("kind = 'view'"), "who", 3.0).withColumn("distance", F.round("distance", 6))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
  SELECT k, CASE WHEN a.v IS NULL THEN 'insert' WHEN b.v IS NULL THEN 'delete' WHEN a.v <> b.v THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b USING (k)""")
def reconcile_fourway(spark, sf):
    side = lambda s: P.read(spark, sf, "orders").where(F.col("o_orderstatus") != s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return J.reconcile(side("P"), side("F"), "k", "v")


# Vector pairs: within a label, so the pair count follows the group sizes.
_PAIRS = f"(SELECT a.person, a.id AS pred, b.id AS succ, list_dot_product(a.v, b.v) AS sim FROM {P.VECTORS} a JOIN {P.VECTORS} b ON a.person = b.person AND a.id < b.id)"


@query(f"SELECT person, pred, succ, round(sim, 6) AS sim FROM {_PAIRS} WHERE sim > 0.25")
def cosine_pairs(spark, sf):
    return B.similar_pairs(P.vectors(spark, sf), "person", 0.25).withColumn("sim", F.round("sim", 6))


_STATED = f"(SELECT pred, succ, round(sim, 6) AS score, CASE WHEN sim > 0.3 THEN 'accepted' ELSE 'review' END AS state FROM {_PAIRS} WHERE sim > 0.2)"


@query(f"""WITH e AS {_STATED}, r AS (SELECT *, max(score) OVER (PARTITION BY pred) AS bp, max(score) OVER (PARTITION BY succ) AS bs,
    nth_value(score, 2) OVER (PARTITION BY pred ORDER BY score DESC, pred, succ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sp,
    nth_value(score, 2) OVER (PARTITION BY succ ORDER BY score DESC, pred, succ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ss FROM e)
  SELECT pred, succ, score, CASE WHEN state = 'accepted' AND ((sp IS NOT NULL AND bp - sp < 0.08 AND bp - score < 0.08) OR (ss IS NOT NULL AND bs - ss < 0.08 AND bs - score < 0.08)) THEN 'review' ELSE state END AS state FROM r""")
def ambiguity_demotion(spark, sf):
    return B.demoted_pairs(P.vectors(spark, sf), "person", 0.2, 0.3)


@query(f"""WITH RECURSIVE e AS (SELECT pred AS u, succ AS v FROM {_PAIRS} WHERE sim > 0.33), both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  reach AS (SELECT u AS node, u AS r FROM both_ UNION SELECT reach.node, both_.v FROM reach JOIN both_ ON reach.r = both_.u) SELECT node, min(r) AS component FROM reach GROUP BY node""")
def components_minlabel(spark, sf):
    return G.components(B.similar_pairs(P.vectors(spark, sf), "person", 0.33), "pred", "succ")


@query()
def components_veto(spark, sf):
    v = P.vectors(spark, sf)
    e = B.similar_pairs(v, "person", 0.25).withColumnRenamed("sim", "score")
    n = v.select("person", F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("shirt"))
    return G.components_with_veto(e, n, "person", ["shirt"])


@query(f"""WITH p AS (SELECT person, 1 + id % 20 AS w, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS c FROM {P.VECTORS}), m AS (SELECT person, i, sum(w * c) / sum(w) AS m FROM p GROUP BY ALL)
  SELECT person, i::INT AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY person)), 6) AS value FROM m""")
def weighted_mean_vector(spark, sf):
    v = P.vectors(spark, sf).withColumn("w", 1 + F.col("id") % 20)
    return G.weighted_mean_vectors(v, "person", "w").withColumn("value", F.round("value", 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY person, pred ORDER BY sim DESC, pred, succ) AS a, row_number() OVER (PARTITION BY person, succ ORDER BY sim DESC, pred, succ) AS b,
    lead(sim) OVER (PARTITION BY person, pred ORDER BY sim DESC, pred, succ) AS na, lead(sim) OVER (PARTITION BY person, succ ORDER BY sim DESC, pred, succ) AS nb FROM (SELECT person, pred, succ, round(sim, 6) AS sim FROM {_PAIRS}))
  SELECT person, pred, succ, sim FROM r WHERE a = 1 AND b = 1 AND (na IS NULL OR sim - na >= 0.02) AND (nb IS NULL OR sim - nb >= 0.02)""")
def mutual_best_margin(spark, sf):
    # The best two of each vector decide, so no other pair is needed.
    return A.mutual_best(B.strongest_pairs(P.vectors(spark, sf), "person").withColumn("sim", F.round("sim", 6)), "person", "pred", "succ", "sim", 0.02)


@query("""SELECT source, last AS target FROM (SELECT o_orderkey AS source, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders) WHERE source <> last""")
def merge_terminals_whole(spark, sf):
    # Every order merges into its customer's next one: whole chains, no residue filter.
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    merges = P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target")).where(F.col("target").isNotNull())
    return G.terminal_targets(spark, merges)
